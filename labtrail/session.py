"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned the way the jobs expect; every value can be overridden."""
    b = (
        SparkSession.builder.master(master)
        .appName("labtrail")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LABTRAIL_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only when the cluster names none (local tests) is one made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="labtrail-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffle_width(df: DataFrame) -> int:
    """Partitions of a shuffle that isn't to be narrowed: rows that are small
    when they are shuffled and much work afterwards."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with the end of the write, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, key: str, met: bool = False) -> DataFrame:
    """:func:`materialize`, with the rows of a ``key`` in one bucket: whatever is grouped by it, or by it and more, needs no shuffle.

    For tables that many aggregates read: each row is shuffled once, and the
    shuffle is gone before they start.  Buckets are as many as shuffles have
    partitions; a key is read by one task.  With ``met`` the caller has
    partitioned the rows by the key."""
    spark, width = df.sparkSession, shuffle_width(df)
    path = scratch_path(spark, label)
    name = f"labtrail_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        rows = df if met else df.repartition(width, key)
        rows.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(width, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the name isn't needed any more, the files stay
    spark.sql(f"DROP TABLE {name}")
    return out
