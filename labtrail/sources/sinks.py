"""Tables and files written for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.functions.basic import blank_to_null, na, placed
from labtrail.operators.insights import alerts_by_category, most_severe_first
from labtrail.operators.resolve import ORDER, SCOPE
from labtrail.operators.timelines import FAR, by_date_and_category
from labtrail.session import materialize
from labtrail.sources.payloads import record_rows, validate_payloads

#: Order of a folder batch's rows.
BATCH_ORDER = ["Test_Name", "Test_Date", "Test_Category", "Patient_ID"]


def append_reports(reports: DataFrame, path: str) -> None:
    """Append-only report table, one folder per normalization version, so a
    reader of the current version never opens older files."""
    reports.write.mode("append").partitionBy("normalization_version").parquet(path)


def append_history(history: DataFrame, path: str) -> None:
    """History lines: snapshot as JSON text, file names joined by commas."""
    history.withColumn("analysis_json", F.to_json("analysis")).withColumn(
        "source_filenames", F.array_join("source_filenames", ",")
    ).drop("analysis").write.mode("append").parquet(path)


def write_organized_csv(table: DataFrame, path: str) -> None:
    """The organized (wide) table with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)


def write_records_csv(records: DataFrame, path: str) -> None:
    """Full record table without derived columns."""
    flat = records.drop("Result_Numeric", "Test_Date_dt")
    arrays = [f.name for f in flat.schema.fields if f.dataType.typeName() == "array"]
    for a in arrays:
        flat = flat.withColumn(a, F.array_join(a, "|"))
    flat.write.mode("overwrite").option("header", True).csv(path)


def append_metrics(events: DataFrame, path: str) -> None:
    """Telemetry log partitioned by day."""
    stamped = events.withColumn("day", F.to_date("created_at"))
    stamped.write.mode("append").partitionBy("day").parquet(path)


def folder_manifest(spark, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Listing of a report folder and all below it; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime")


def folder_batch(manifest: DataFrame, payloads: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows of a folder's reports, and what became of each file.

    ``payloads``: (file_name, payload) of any files, the payload as JSON text;
    those of files that aren't listed are left out.  The second table has each
    listed file with its rows and ``skipped``, true if it gave none.
    """
    carry = carry or []
    names = manifest.select("file_name").distinct()
    valid = validate_payloads(payloads.join(names, "file_name", "left_semi"))
    rows = materialize(record_rows(valid, F.col("file_name"), carry), "folder-rows")
    counts = rows.groupBy(F.col("Source_Filename").alias("file_name")).agg(F.count(F.lit(1)).alias("rows"))
    files = names.join(counts, "file_name", "left").select("file_name", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNull().alias("skipped"))
    return rows, files


def write_sorted_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Record table sorted over all its files: read by name, their lines are in order; nulls come last."""
    write_records_csv(rows.orderBy(*[F.col(c).asc_nulls_last() for c in order or BATCH_ORDER]), path)


def print_table(records: DataFrame) -> DataFrame:
    """Columns of the printed report: names cut to thirty characters."""
    text = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return records.select(
        "row_ord", F.substring(F.coalesce("Test_Name", F.lit("N/A")), 1, 30).alias("Test_Name"), text("Result", "N/A"),
        text("Unit", ""), text("Reference_Range", "N/A"), text("Status", "Normal"),
    )


# --- tables of the patient's printed report -----------------------------------
def printed_alerts(concern_rows: DataFrame) -> DataFrame:
    """Alerts by category, the most severe first (``place``), with the severity in capitals."""
    return most_severe_first(alerts_by_category(concern_rows)).withColumn("severity", F.upper("severity"))


def printed_category_tests(concern_rows: DataFrame) -> DataFrame:
    """The alerts of each category, one line a test, in the order of the records (``place``)."""
    text = lambda c, new: F.coalesce(blank_to_null(F.col(c)), na()).alias(new)
    category = F.coalesce(blank_to_null(F.col("category")), F.lit("Uncategorized"))
    lines = placed(concern_rows.withColumn("category", category), [SCOPE, "category"], ORDER)
    return lines.select(SCOPE, "category", "place", F.col("test_name").alias("test"), text("result", "value"), text("reference", "reference"), text("status", "status"), text("date", "date"))


def printed_dates(records: DataFrame) -> DataFrame:
    """Total tests, categories and alerts of each date, newest first (``place``); unknown dates come last."""
    rows = by_date_and_category(records)
    alert = F.lower(F.coalesce("Status", F.lit(""))).isin("high", "low", "critical", "positive")
    counted = rows.groupBy(SCOPE, "date").agg(
        F.max("day").alias("day"), F.count(F.lit(1)).alias("total_tests"), F.countDistinct("category").alias("categories"), F.count_if(alert).alias("alerts")
    )
    known = F.when(F.col("day") < F.lit(FAR).cast("date"), F.col("day"))
    return placed(counted, SCOPE, known.desc_nulls_last(), F.col("date")).drop("day")
