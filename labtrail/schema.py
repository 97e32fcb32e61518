"""The lab record and the documents it travels in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_TEXT_FIELDS = [
    "Source_Filename", "Patient_ID", "Patient_Name", "Age", "Gender", "Test_Date",
    "Lab_Name", "Test_Category", "Original_Test_Name", "Test_Name", "Result", "Unit",
    "Reference_Range", "Status",
]
RECORD_FIELDS = RECORD_TEXT_FIELDS + ["Processed_Date", "Result_Numeric", "Test_Date_dt"]

PATIENT_FIELDS = ["name", "age", "gender", "patient_id", "date", "lab_name"]

PATIENT_INFO = T.StructType([T.StructField(f, T.StringType()) for f in PATIENT_FIELDS])

EXTRACTED_TEST = T.StructType(
    [
        T.StructField(f, T.StringType())
        for f in ("test_name", "result", "unit", "reference_range", "status", "category")
    ]
)

RECORD = T.StructType(
    [T.StructField(f, T.StringType()) for f in RECORD_TEXT_FIELDS]
    + [T.StructField("Aliases", T.ArrayType(T.StringType()))]
)

#: A record as stored reports hold it.
STORED_RECORD = T.StructType(
    RECORD.fields
    + [T.StructField("Processed_Date", T.StringType()), T.StructField("Result_Numeric", T.DoubleType()), T.StructField("Test_Date_dt", T.StringType())]
)


def pad_columns(df: DataFrame, columns: list[str], default: str | None = None) -> DataFrame:
    """Add missing columns with a default and put the listed ones first."""
    rest = [c for c in df.columns if c not in columns]
    picked = [
        F.col(c) if c in df.columns else F.lit(default).cast("string").alias(c) for c in columns
    ]
    return df.select(*picked, *[F.col(c) for c in rest])


def union_padded(*frames: DataFrame) -> DataFrame:
    """Union by name; a column a frame lacks becomes null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c, F.lit(" \t\n\r\x0b\x0c")) == "")
