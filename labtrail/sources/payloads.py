"""Extraction payloads, stored report documents, history snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import names as nm
from labtrail.functions import status as st
from labtrail.functions import values as va
from labtrail.functions.basic import blank_to_null, let
from labtrail.operators.dictionary import with_derived
from labtrail.schema import EXTRACTED_TEST, PATIENT_FIELDS, PATIENT_INFO, STORED_RECORD
from labtrail.session import materialize

_TEXTS = "array<string>"


def json_fields(c: Column) -> Column:
    """Top-level fields as raw JSON text; null when it is not an object."""
    return F.from_json(c, "map<string,string>")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later columns use
    them: Spark merges no projection across the one-element explode."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made.alias("_once")).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])


def _clean(c: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def clean_patient(p: Column) -> Column:
    day = va.parse_date_day_first(p["date"])
    fields = [
        (va.format_day_first(day) if f == "date" else _clean(p[f], "N/A")).alias(f) for f in PATIENT_FIELDS
    ]
    return F.struct(*fields)


def clean_test(t: Column) -> Column:
    """One usable test, null when its name or result is missing.  Category and
    status keep their words; :func:`record_rows` makes them canonical, once
    per distinct spelling."""
    row = F.struct(
        blank_to_null(t["test_name"]).alias("test_name"), blank_to_null(t["result"]).alias("result"),
        _clean(t["unit"], "").alias("unit"), _clean(t["reference_range"], "N/A").alias("reference_range"),
        t["status"].alias("status"), _clean(t["category"], "Other").alias("category"),
    )
    return F.when(blank_to_null(t["test_name"]).isNotNull() & blank_to_null(t["result"]).isNotNull(), row)


def validate_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Checked payload columns: ``is_valid``, ``patient_info``, ``test_results``,
    ``summary``, ``issues``.  Nothing leaves the row it came from."""
    def field(name: str) -> Column:
        return F.try_element_at(F.col("_top"), F.lit(name))

    top = once(df, _top=json_fields(F.col(payload)))
    texts = once(top, _i=field("patient_info"), _t=field("test_results"), _s=field("abnormal_findings_summary_from_report"))
    info, tests, summary = F.col("_i"), F.col("_t"), F.col("_s")
    parts = once(
        texts,
        _info=F.when(F.startswith(info, F.lit("{")), F.from_json(info, PATIENT_INFO)),
        _items=F.when(F.startswith(tests, F.lit("[")), F.from_json(tests, _TEXTS)),
        _notes=F.when(F.startswith(summary, F.lit("[")), F.from_json(summary, _TEXTS)).when(~F.startswith(summary, F.lit("{")), F.array(summary)),
    )
    parsed = F.transform(
        "_items", lambda x: let(F.when(F.startswith(x, F.lit("{")), F.from_json(x, EXTRACTED_TEST)), clean_test)
    )
    staged = once(parts, test_results=F.coalesce(F.array_compact(parsed), F.array().cast(f"array<{EXTRACTED_TEST.simpleString()}>")))
    bad = F.coalesce(F.size("_items") - F.size("test_results"), F.lit(0))
    is_object = F.col("_top").isNotNull()
    has_info = F.col("_info").isNotNull()
    has_tests = F.col("_items").isNotNull()
    issues = F.array_compact(F.array(
        F.when(~has_info, "patient_info is not an object"), F.when(~has_tests, "test_results is not an array"),
        F.when(has_tests & (bad > 0), F.concat(F.lit("dropped entries: "), bad.cast("string"))),
        F.when(F.size("test_results") == 0, "no usable entry"),
    ))
    notes = F.filter(F.transform("_notes", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    nobody = F.struct(*[F.lit(None).cast("string").alias(f) for f in PATIENT_FIELDS])
    return staged.withColumns({
        "issues": F.when(is_object, issues).otherwise(F.array(F.lit("not a JSON object"))),
        "is_valid": is_object & has_info & has_tests & (F.size("test_results") > 0),
        "patient_info": let(F.coalesce("_info", nobody), clean_patient),
        "summary": F.coalesce(notes, F.array().cast(_TEXTS)),
    }).drop("_top", "_i", "_t", "_s", "_info", "_items", "_notes")


def record_rows(valid: DataFrame, file_name: Column, carry: list[str]) -> DataFrame:
    """Record rows of validated payloads, one per test."""
    rows = valid.select(*carry, file_name.alias("Source_Filename"), "patient_info", F.posexplode("test_results").alias("pos", "t"))
    p = {"Patient_ID": "patient_id", "Patient_Name": "name", "Age": "age", "Gender": "gender", "Test_Date": "date", "Lab_Name": "lab_name"}
    flat = rows.select(
        *carry, "pos", "Source_Filename", *[F.col(f"patient_info.{v}").alias(k) for k, v in p.items()],
        F.col("t.test_name").alias("Original_Test_Name"), F.col("t.result").alias("Result"),
        F.col("t.reference_range").alias("Reference_Range"), F.col("t.unit").alias("_unit"),
        F.col("t.status").alias("_status"), F.col("t.category").alias("_category"),
    )
    # read twice, for the spellings and for the rows; the payloads are parsed once
    flat = materialize(flat, "extracted-rows")
    names = {"_std": nm.standard_test_name(F.col("_key")), "Test_Name": nm.normalize_test_name(F.col("_std"))}
    out = with_derived(flat, {"Original_Test_Name": names}).withColumns({
        "Unit": nm.standard_unit(F.col("_unit")), "Status": st.canonical_status(F.col("_status")), "Test_Category": nm.canonical_category(F.col("_category")),
    }).drop("_std", "_unit", "_status", "_category")
    return out.withColumn("Result_Numeric", va.strict_numeric(F.col("Result"))).withColumn(
        "Test_Date_dt", va.parse_date_day_first(F.col("Test_Date"))
    )


def override_statuses(fallback: Column, classifications: Column) -> Column:
    """Statuses by position after classified ones replaced them: positions out
    of range are ignored and N/A never replaces a known status."""
    items = F.from_json(classifications, "array<struct<index:int,status:string>>")
    listed = F.coalesce(F.filter(items, lambda i: i["index"].isNotNull()), F.array().cast("array<struct<index:int,status:string>>"))
    # the last of each index, before any status is read
    latest = F.aggregate(
        listed, F.create_map().cast("map<int,string>"),
        lambda acc, i: F.map_concat(F.map_filter(acc, lambda k, v: k != i["index"]), F.create_map(i["index"], i["status"])),
    )
    named = let(latest, lambda m: F.transform_values(m, lambda k, v: st.canonical_status(v)))

    def merged(new: Column, known: Column) -> Column:
        return F.when(new.isNull() | ((new == "N/A") & (known != "N/A")), known).otherwise(new)

    # once a row, not once for every use at every position
    return let(named, lambda m: F.transform(fallback, lambda known, at: let(F.try_element_at(m, at), lambda new: merged(new, known))))


# --- stored documents -------------------------------------------------------
def document_records(reports: DataFrame, column: str = "analysis_data") -> DataFrame:
    """Records inside stored report documents with their position."""
    parsed = reports.withColumn("_d", F.from_json(column, f"records array<{STORED_RECORD.simpleString()}>"))
    return parsed.select(*[c for c in reports.columns if c != column], F.posexplode_outer("_d.records").alias("pos", "r")).select(
        *[c for c in reports.columns if c != column], "pos", "r.*"
    )


def history_snapshots(history: DataFrame, column: str = "analysis_json") -> DataFrame:
    """History lines whose snapshot is readable JSON; others are skipped."""
    return history.withColumn("snapshot", json_fields(F.col(column))).where("snapshot IS NOT NULL")


def alerts_in_document(c: Column) -> Column:
    """Number of concerns in a stored document, zero when there are none."""
    found = F.from_json(F.get_json_object(c, "$.health_summary.concerns"), _TEXTS)
    return F.when(found.isNull(), 0).otherwise(F.size(found))


def content_key(text: Column, first: int | None = None) -> Column:
    """Names a text: equal texts have equal keys.  Whole texts, unless the
    caller asks for their ``first`` characters only."""
    return F.md5(F.encode(text if first is None else F.substring(text, 1, first), "utf-8"))


def text_table(texts: DataFrame, column: str = "text", key_chars: int | None = None) -> DataFrame:
    """Preview and content key of report texts."""
    return texts.withColumn("preview", F.substring(column, 1, 2000)).withColumn("content_key", content_key(F.col(column), key_chars))


def first_by_key(texts: DataFrame, order: str) -> DataFrame:
    """One text per content key, the first by ``order``."""
    return texts.groupBy("content_key").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
