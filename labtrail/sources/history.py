"""Earlier exports: wide tables (one column per date and laboratory) and long
tables, read back into record rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.functions.basic import na

from labtrail.functions import text as tx
from labtrail.functions import values as va
from labtrail.functions.basic import strip
from labtrail.schema import RECORD_FIELDS, pad_columns
from labtrail.sources import stacked

KEYS = ["Test_Category", "Test_Name"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; no inference pass over the data."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)


def read_stacked_files(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of any number of exports with stacked headers, each with columns of its own."""
    stacked.register(spark)
    return spark.read.format("stacked_headers").load(path)


def _is_data_column(name: str) -> bool:
    low = name.lower()
    skip = ("reference" in low and "range" in low) or low in ("ref_range", "col", "column") or low.startswith("unnamed")
    return name not in KEYS and not skip


def unpivot_history(
    df: DataFrame,
    file_name: str,
    patient: dict[str, str] | None = None,
    default_lab: str = "Lab",
    reformat_dates: bool = False,
    carry: list[str] | None = None,
    skip_header_rows: bool = False,
) -> DataFrame:
    """Wide to long: one row per non-empty cell.

    ``carry`` lists extra key columns (a scope, say).  ``patient`` fills the
    patient fields; without it the name is read off the file name.
    """
    carry = carry or []
    cols = [c for c in df.columns if _is_data_column(c) and c not in carry]
    ranges = F.col("Reference_Ranges") if "Reference_Ranges" in df.columns else F.lit(None).cast("string")
    name = strip(F.col("Test_Name"))
    rows = df.withColumn("_ref", strip(ranges)).where(
        name.isNotNull() & ~F.lower(name).isin("", "nan", "test_name")
    )
    if skip_header_rows:
        low = F.lower(strip(F.col(df.columns[0])))
        for mark in ("\U0001F4C5", "\U0001F3E5", "date", "lab", "test_category", "unnamed"):
            rows = rows.where(~F.contains(F.coalesce(low, F.lit("")), F.lit(mark)))
    long = rows.unpivot([*carry, *KEYS, "_ref"], cols, "_date_lab", "Result")
    long = long.where(~strip(F.col("Result")).isin("", "None", "nan"))
    # what a column's name says is read once a column, not once a cell
    parts = F.split("_date_lab", "_", 2)
    headers = df.sparkSession.createDataFrame([(c,) for c in cols], "_date_lab string").withColumns(
        {"_date": F.get(parts, F.lit(0)), "_lab": F.get(parts, F.lit(1)), "_day": va.parse_date_day_first(F.get(parts, F.lit(0)))}
    ).withColumn("_shown", F.coalesce(F.date_format("_day", "dd-MM-yyyy"), "_date"))
    long = long.join(F.broadcast(headers), "_date_lab")
    if patient is None:
        patient = {}
        person = tx.patient_from_export_name(F.lit(file_name))
    else:
        person = F.lit(patient.get("name", "Patient"))
    return long.select(
        *carry, F.lit(file_name).alias("Source_Filename"), F.lit(patient.get("patient_id", "N/A")).alias("Patient_ID"),
        person.alias("Patient_Name"), F.lit(patient.get("age", "N/A")).alias("Age"), F.lit(patient.get("gender", "N/A")).alias("Gender"),
        F.col("_shown" if reformat_dates else "_date").alias("Test_Date"),
        F.coalesce("_lab", F.lit(default_lab)).alias("Lab_Name"),
        strip(F.coalesce("Test_Category", F.lit("General"))).alias("Test_Category"),
        name.alias("Original_Test_Name"), name.alias("Test_Name"), "Result", na().alias("Unit"),
        F.when(F.lower("_ref").isin("", "nan"), na()).otherwise(F.coalesce("_ref", na())).alias("Reference_Range"), na().alias("Status"),
        va.strict_numeric(F.col("Result")).alias("Result_Numeric"), F.col("_day").alias("Test_Date_dt"),
    )


def looks_like_date(name: str) -> bool:
    """Column-name check on the driver (metadata only)."""
    import re

    return bool(re.match(r"^\s*(\d{1,2}[-/.]\d{1,2}[-/.](\d{4}|\d{2})|\d{4}-\d{1,2}-\d{1,2}|\d{1,2} [A-Za-z]{3} \d{4})\s*$", name))


def detect_and_unpivot(df: DataFrame, file_name: str, patient: dict[str, str] | None = None, carry: list[str] | None = None) -> DataFrame | None:
    """First column is the test, date-like columns follow: a plain wide table.
    Null when the table does not look like one."""
    carry = carry or []
    first = next(c for c in df.columns if c not in carry)
    if not any(looks_like_date(c) for c in df.columns if c != first):
        return None
    named = df.withColumnRenamed(first, "Test_Name").withColumn("Test_Category", F.lit("General"))
    return unpivot_history(named, file_name, patient, default_lab="General Lab", carry=carry)


def read_long_export(df: DataFrame, file_name: str, processed: Column | None = None) -> DataFrame:
    """Long export: pad, restamp, retype, drop rows without a test name."""
    out = pad_columns(df, RECORD_FIELDS, "N/A")
    out = out.withColumn("Source_Filename", F.lit(file_name)).withColumn("Result_Numeric", va.strict_numeric(F.col("Result")))
    out = out.withColumn("Test_Date_dt", va.parse_date_day_first(F.col("Test_Date")))
    out = out.withColumn("Processed_Date", processed if processed is not None else F.current_timestamp())
    return out.where(F.col("Test_Name").isNotNull() & (F.col("Test_Name") != "N/A"))
