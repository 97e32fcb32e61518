"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labtrail.session import materialize

__all__ = ["materialize", "table", "free_name", "row_batches", "arrow_schema", "parts_for"]

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while the table has a column of that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def parts_for(rows: int, each: int) -> int:
    """How many groups of about ``each`` rows hold ``rows`` rows; at least one."""
    return max(1, -(-rows // each))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    """The Arrow schema of a flat Spark schema, for building output batches."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    plain = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(),
        T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
    }
    return plain[type(kind)]


def row_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Thinner batches, so that few whole texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
