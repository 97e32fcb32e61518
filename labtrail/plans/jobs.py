"""Whole jobs composed from the operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions import values as va
from labtrail.functions.basic import blank_to_null, na
from labtrail.operators import insights as ins
from labtrail.operators import records as rec
from labtrail.operators.resolve import ORDER, resolve_records
from labtrail.schema import PATIENT_INFO, RECORD, STORED_RECORD
from labtrail.session import materialize, materialize_by, shuffle_width

REPORT = ["study_id", "report_id"]
#: Rules by which stored records were normalized.
CURRENT_VERSION = 1
PATIENT_PAYLOAD = f"patient_info {PATIENT_INFO.simpleString()}"
CONTENT = [
    "Test_Name", "Original_Test_Name", "Test_Category", "Test_Date", "Result", "Unit",
    "Reference_Range", "Status", "Source_Filename",
]


def analyze(new: DataFrame, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Union, clean, resolve once, then every insight from the same records."""
    rows = rec.combine(existing, new) if existing is not None else new
    records = rec.with_typed_columns(resolve_records(rec.drop_empty(rows)))
    return {
        "records": records,
        "overall": ins.overall_score(records),
        "categories": ins.category_scores(records),
        "concerns": ins.concerns(records),
        "body_systems": ins.body_systems(records),
    }


def combined_reports(stored: DataFrame, legacy: DataFrame, reports: DataFrame | None = None, spelled_in: DataFrame | None = None) -> DataFrame:
    """One record table per study.

    ``stored`` rows were normalized when saved and are used as they are;
    ``legacy`` rows are cut to their report's file and normalized here.  Only
    studies with legacy rows are normalized again as a whole, and their rows
    are the only ones read for it.  Both intermediate tables are written to
    the shared folder: each is read several times, the second by study, without
    a shuffle.  Without ``reports`` the
    legacy rows have their report's file in ``_file`` and lie by report already;
    ``spelled_in`` has them too, for the names.
    """
    sliced = rec.slice_deterministic(legacy, reports)
    fresh = materialize(resolve_records(sliced, REPORT, met=True, spelled_in=legacy if spelled_in is None else spelled_in), "fresh")
    joined = rec.combine(stored.select(fresh.columns), fresh)
    # rows of equal content are of one study, and so is all that is asked of them afterwards
    of_study = joined.repartition(shuffle_width(joined), "study_id")
    once = materialize_by(
        rec.distinct_rows(of_study, [c for c in joined.columns if c not in (ORDER, "report_id")]), "combined", "study_id", met=True
    )
    redo = fresh.select("study_id").distinct()
    clean = once.join(redo, "study_id", "left_anti")
    again = resolve_records(once.join(redo, "study_id", "left_semi"), ["study_id"], met=True)
    return rec.combine(clean, again.select(clean.columns))


def parsed_reports(reports: DataFrame, version: int = CURRENT_VERSION) -> DataFrame:
    """Reports with their texts parsed, written once for all that is asked of them.

    ``reports``: (study_id, report_id, profile_id, file_name, report_date,
    lab_name, is_normalized, normalization_version, normalized_records,
    analysis_data), the last two as JSON text.  ``records`` are the stored ones
    if they were normalized by the current rules (``current``), else the raw
    ones; ``filled`` tells whether the analysis has any content."""
    current = F.col("is_normalized") & (F.col("normalization_version") == version) & F.startswith(F.trim("normalized_records"), F.lit("["))
    current = F.coalesce(current, F.lit(False))
    listed = F.when(current, F.from_json("normalized_records", f"array<{STORED_RECORD.simpleString()}>")).otherwise(
        F.from_json("analysis_data", f"records array<{STORED_RECORD.simpleString()}>")["records"])
    kept = F.transform(listed, lambda r: F.when(r.isNotNull(), F.struct(*[r[c].alias(c) for c in RECORD.fieldNames()])))
    filled = F.length(F.regexp_replace(F.coalesce("analysis_data", F.lit("")), r"[\s{}]", "")) > 0
    return materialize(reports.select(
        *REPORT, "profile_id", "file_name", "report_date", "lab_name", current.alias("current"), kept.alias("records"),
        F.from_json("analysis_data", PATIENT_PAYLOAD)["patient_info"].alias("patient_info"), filled.alias("filled"),
    ), "parsed-reports")


def stored_and_legacy(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of parsed reports: those normalized by the current rules, as they
    are, and the raw rows of all others, with their report's file in ``_file``,
    once by report and once as they lie.

    Rows are in order of their reports, then of their places.  To lie by report
    documents are shuffled, which are smaller than their rows."""

    def rows(df: DataFrame) -> DataFrame:
        flat = df.select(*REPORT, F.col("file_name").alias("_file"), F.posexplode("records").alias("_pos", "r")).where("r IS NOT NULL")
        order = F.format_string("%020d.%08d", "report_id", "_pos")
        return flat.select(*REPORT, order.alias(ORDER), "_file", "r.*")

    stored, others = rows(parsed.where("current")), parsed.where("NOT current")
    return rec.with_source_file(stored, F.col("_file")).drop("_file"), rows(others.repartition("report_id")), rows(others)


def report_patients(parsed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Patient line of each study: the latest payload's details, then the
    profile's name, the last report's date and the first report's laboratory."""
    at = F.col("report_id")
    facts = parsed.groupBy("study_id", "profile_id").agg(
        F.max_by("patient_info", F.when(F.col("filled"), at)).alias("p"), F.max_by("report_date", at).alias("last"), F.min_by("lab_name", at).alias("lab"),
    ).join(profiles.select("profile_id", "full_name", "owner_id"), "profile_id", "left")
    given = lambda f: blank_to_null(F.col(f"p.{f}"))
    return facts.select(
        "study_id", F.coalesce(given("name"), "full_name", na()).alias("name"), F.coalesce(given("age"), na()).alias("age"), F.coalesce(given("gender"), na()).alias("gender"),
        F.coalesce(given("patient_id"), F.col("owner_id").cast("string"), na()).alias("patient_id"),
        F.coalesce(given("date"), F.date_format("last", "yyyy-MM-dd"), na()).alias("date"), F.coalesce(given("lab_name"), "lab", na()).alias("lab_name"),
    )


def study_reports(reports: DataFrame, profiles: DataFrame, version: int = CURRENT_VERSION) -> dict[str, DataFrame]:
    """Everything a combined study report shows, for all studies at once."""
    parsed = parsed_reports(reports, version)
    stored, legacy, unsorted = stored_and_legacy(parsed)
    records = materialize(combined_reports(stored, legacy, spelled_in=unsorted), "study-records")
    has_rows = F.exists("records", lambda r: r.isNotNull())
    with_data = parsed.where(has_rows).select(*REPORT).distinct().groupBy("study_id").agg(F.count(F.lit(1)).alias("reports_with_data"))
    scope = ["study_id"]
    files = parsed.groupBy("study_id").agg(F.count(F.lit(1)).alias("reports"))
    return {
        "records": records,
        "overall": ins.overall_score(records, scope),
        "categories": ins.category_scores(records, scope),
        "concerns": ins.concerns(records, scope),
        "body_systems": ins.body_systems(records, scope),
        "patients": report_patients(parsed, profiles),
        "totals": files.join(with_data, "study_id", "left").withColumn("reports_with_data", F.coalesce("reports_with_data", F.lit(0))),
    }


def save_reports(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Records of each report, normalized, with the report's inferred date and
    the version stamp; ready for the append sink."""
    # rows meet their report's file by report and stay there: for its date and for their places
    scoped = rec.slice_by_file(rows, reports, fallback_to_all=False)
    scoped = scoped.where(reduce(and_, [F.col(c).isNotNull() for c in REPORT]))
    first = F.min_by("_day", F.when(F.col("_day").isNotNull(), F.col(ORDER))).over(Window.partitionBy(*REPORT))
    dated = scoped.withColumn("_day", va.parse_report_date(F.col("Test_Date"))).withColumn("report_date", first).drop("_day")
    saved = resolve_records(dated, REPORT, met=True, spelled_in=rows)
    return saved.withColumn("normalization_version", F.lit(CURRENT_VERSION))


def _digest_parts(sig: Column) -> list[Column]:
    return [F.conv(F.substring(sig, at, 12), 16, 10).cast("decimal(38,0)") for at in (1, 21)]


def digest_sums() -> list[Column]:
    """Aggregates of an order-free digest: row count and two sums of 48-bit hashes."""
    a, b = _digest_parts(va.signature(*CONTENT))
    return [F.count(F.lit(1)).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b")]


def content_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free digest of each group."""
    return rows.groupBy(*keys).agg(*digest_sums())


def content_digest_of(records: str) -> Column:
    """The same digest (n, a, b) of an array of records, null entries left out; null if it has no other."""
    zero = F.lit(0).cast("decimal(38,0)")

    def add(acc: Column, r: Column) -> Column:
        a, b = _digest_parts(F.sha2(F.to_json(F.struct(*[r[c].alias(c) for c in sorted(CONTENT)]), {"ignoreNullFields": "false"}), 256))
        return F.struct((acc["n"] + 1).alias("n"), (acc["a"] + a).cast("decimal(38,0)").alias("a"), (acc["b"] + b).cast("decimal(38,0)").alias("b"))

    start = F.struct(F.lit(0).cast("long").alias("n"), zero.alias("a"), zero.alias("b"))
    found = F.aggregate(F.filter(records, lambda r: r.isNotNull()), start, add)
    return F.when(found["n"] > 0, found)


def renormalize(rows: DataFrame, keys: list[str] = REPORT) -> tuple[DataFrame, DataFrame]:
    """Migration: records at the current version, and per report whether its
    content changed."""
    after = resolve_records(rows, keys)
    old, new = content_digest(rows, keys), content_digest(after, keys)
    pairs = old.alias("o").join(new.alias("w"), keys)
    same = (F.col("o.n") == F.col("w.n")) & (F.col("o.a") == F.col("w.a")) & (F.col("o.b") == F.col("w.b"))
    return after, pairs.select(*keys, (~same).alias("updated"))
