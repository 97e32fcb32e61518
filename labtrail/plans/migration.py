"""Stored payloads brought to the present normalization rules.

Reports and history lines keep a document as JSON text.  Its records are
normalized again, all documents at once; a document is *updated* if its records
or their stored number change.  What was done is counted while the result is
written (``observe``), and the result goes to partitions of its version and of
the version it came from: a migration that is run again replaces its own
partitions and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labtrail.operators.resolve import ORDER, resolve_records
from labtrail.plans.jobs import CURRENT_VERSION, REPORT, content_digest_of, digest_sums
from labtrail.schema import PATIENT_FIELDS, PATIENT_INFO, RECORD_TEXT_FIELDS, STORED_RECORD
from labtrail.session import materialize, shuffle_width

DOCUMENT = f"records array<{STORED_RECORD.simpleString()}>, total_records long, patient_info {PATIENT_INFO.simpleString()}"
KEPT = [*RECORD_TEXT_FIELDS, "Aliases"]


def normalized_documents(documents: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per document (distinct ``keys``): ``readable``, ``patient_info``, ``normalized_records`` as JSON, ``total_records``, and ``updated``; other columns of ``documents`` stay.

    A document that is no JSON object has no records.  Documents are shuffled
    whole and their rows stay together: what is asked of a document needs no
    other shuffle, and the rest of it follows without its records.
    """
    carry = [c for c in documents.columns if c not in (*keys, column)]
    tree = F.try_parse_json(column)
    readable = F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    read = materialize(documents.select(*keys, *carry, readable.alias("readable"), F.from_json(column, DOCUMENT).alias("d")), "documents")
    parsed = read.select(*keys, *carry, "readable", F.when(F.col("readable"), F.col("d.records")).alias("_records"), F.col("d.patient_info").alias("patient_info"), F.col("d.total_records").alias("_stated"))
    old = content_digest_of("_records")
    docs = parsed.select(*keys, "_records").where(F.size("_records") > 0)
    rows = lambda df: df.select(*keys, F.posexplode("_records").alias(ORDER, "r")).where("r IS NOT NULL").select(*keys, ORDER, *[F.col(f"r.{c}").alias(c) for c in KEPT])
    after = resolve_records(rows(docs.repartition(shuffle_width(read), *keys)), keys, met=True, spelled_in=rows(docs))
    record = F.struct(*[F.col(c) for c in KEPT])
    packed = after.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(ORDER, record.alias("r")))), lambda x: x["r"]).alias("records"), *digest_sums())
    rest = parsed.select(*keys, *carry, "readable", "patient_info", "_stated", old.alias("_old"))
    n, none = F.coalesce("n", F.lit(0)), F.array().cast(packed.schema["records"].dataType)
    new = F.when(F.col("n").isNotNull(), F.struct("n", "a", "b"))
    return rest.join(packed, keys, "left").select(
        *keys, *carry, "readable", "patient_info", F.to_json(F.coalesce("records", none)).alias("normalized_records"), n.alias("total_records"),
        (~F.col("_old").eqNullSafe(new) | ~F.col("_stated").eqNullSafe(n)).alias("updated"),
    )


def migrate_reports(reports: DataFrame, version: int = CURRENT_VERSION) -> DataFrame:
    """Reports (study_id, report_id, normalization_version, analysis_data) of other versions, at ``version``.

    An unreadable document becomes an empty one."""
    stale = reports.where(~F.col("normalization_version").eqNullSafe(F.lit(version)))
    source = F.coalesce("normalization_version", F.lit(0)).alias("source_version")
    return normalized_documents(stale.select(*REPORT, "analysis_data", source), REPORT, "analysis_data").select(
        *REPORT, "normalized_records", "total_records", (F.col("updated") | ~F.col("readable")).alias("updated"),
        F.lit(True).alias("is_normalized"), F.lit(version).alias("normalization_version"), "source_version",
    )


def migrate_history(history: DataFrame) -> DataFrame:
    """History lines (id, patient fields, total_records, analysis_json): updated ones take records, number and patient from their document.

    Lines whose document is unreadable are ``skipped`` and stay."""
    own = ["patient_name", "patient_age", "patient_gender", "patient_id", "report_date", "lab_name"]
    line = history.select("id", "analysis_json", *own, F.col("total_records").alias("_line_total"))
    joined = normalized_documents(line, ["id"], "analysis_json").withColumn("updated", F.col("readable") & F.col("updated"))
    column = {"name": "patient_name", "age": "patient_age", "gender": "patient_gender", "patient_id": "patient_id", "date": "report_date", "lab_name": "lab_name"}
    # a document without a patient leaves the line's own
    patient = {c: F.when(F.col("updated") & F.col("patient_info").isNotNull(), F.col(f"patient_info.{f}")).otherwise(F.col(c)) for f, c in column.items()}
    return joined.select(
        "id", *[patient[column[f]].alias(column[f]) for f in PATIENT_FIELDS], F.when(F.col("updated"), F.col("total_records")).otherwise(F.col("_line_total")).alias("total_records"),
        F.when(F.col("updated"), F.col("normalized_records")).alias("normalized_records"), "updated", (~F.col("readable")).alias("skipped"),
    )


def write_counted(rows: DataFrame, path: str, counts: dict[str, Column], partitions: list[str] | None = None) -> dict[str, int]:
    """Writes ``rows``, replacing only the partitions they have, and counts them in the same pass."""
    seen = Observation("migration")
    writer = rows.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]).write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)
    return seen.get


def migrate(reports: DataFrame, history: DataFrame, path: str, version: int = CURRENT_VERSION) -> dict[str, dict[str, int]]:
    """Both migrations, written below ``path``: how many of each were updated, unchanged or skipped."""
    updated, skipped = F.col("updated"), F.col("skipped")
    return {
        "reports": write_counted(migrate_reports(reports, version), f"{path}/reports", {"updated": updated, "unchanged": ~updated}, ["normalization_version", "source_version"]),
        "history": write_counted(migrate_history(history), f"{path}/history", {"updated": updated, "unchanged": ~updated & ~skipped, "skipped": skipped}),
    }
