"""A store of keys that have been seen, of which a batch opens only what it may hit.

Keys are dealt to buckets by a hash, each bucket a folder.  A filter stands
before them: one bit array of ``SLOTS`` slots of 32,768 bits, in which every key
sets the bit of its hash.  A key whose bit isn't set is new, without a look at
any file of keys; only the buckets of the others are read, and those keys are
compared in full.

Each batch writes its own bits and keys under its number; every ``MERGE``
batches the bits of all batches so far are merged, so a batch reads one merged
filter and the bits of a few batches, however many there were.  A batch that is
replayed doesn't look at what it wrote itself and writes it again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: At ten million keys so many slots hold a new key for seen in 7 of 100 cases, which costs reading its bucket.
SLOTS = 4096
SLOT_BITS = 32_768
MERGE = 16
BITS = "slot long, bits binary"


class KeyStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "content_key"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _read(self, schema: str, *paths: str) -> DataFrame:
        """What lies in folders of one kind, by one scan however many they are;
        one that isn't there holds nothing."""
        try:
            if paths:
                return self.spark.read.schema(schema).option("basePath", self.path + "/" + paths[0].split("/")[0]).parquet(f"{self.path}/{{{','.join(paths)}}}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        return self.spark.createDataFrame([], schema)

    def hashed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the slot, bit and bucket of their key."""
        h = F.pmod(F.xxhash64(self.key), F.lit(SLOTS * SLOT_BITS)) + 1
        return rows.withColumns({"slot": F.bitmap_bucket_number(h), "bit": F.bitmap_bit_position(h), "bucket": F.pmod(F.xxhash64(self.key, F.lit("bucket")), F.lit(BUCKETS)).cast("int")})

    def bits(self, batch_id: int) -> DataFrame:
        """The filter of all batches but this one: its slots that have bits set."""
        merged = self._read(BITS + ", upto long", "merged").where(F.col("upto") < batch_id)
        upto = merged.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        own = self._read(BITS + ", batch long", *[f"bits/batch={b}" for b in range(upto + 1, batch_id)])
        rows = merged.where(F.col("upto") == upto).select("slot", "bits").unionByName(own.select("slot", "bits"))
        return rows.groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits"))

    def built(self, hashed: DataFrame) -> DataFrame:
        """The bits of hashed rows.  The rows of a slot meet while they are two
        numbers; bits that each task sets by itself are 4 kB a slot and task."""
        return hashed.select("slot", "bit").repartition("slot").groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def suspects(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The hashed rows whose bit is set: all that were seen before, and few others."""
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
        return rows.join(self.bits(batch_id), "slot").where(on).drop("bits")

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """One row of each key of ``rows`` that no other batch has stored."""
        columns = rows.columns
        new = self.hashed(rows.dropDuplicates([self.key]))
        asked = self.suspects(new.select(self.key, "slot", "bit", "bucket"), batch_id)
        # at most as many numbers as there are buckets
        opened = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
        known = self._read(f"{self.key} string, bucket int, batch long", *[f"keys/bucket={b}" for b in opened])
        seen = known.where(F.col("batch") != batch_id).select(self.key).join(asked.select(self.key), self.key, "left_semi")
        return new.join(seen, self.key, "left_anti").select(*columns)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Stores the keys of ``rows`` as those of a batch."""
        new = self.hashed(rows.select(self.key)).withColumn("batch", F.lit(batch_id).cast("long"))
        kept = new.select(self.key, "bucket", "batch").repartition("bucket")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/keys")
        self.built(new).write.mode("overwrite").parquet(f"{self.path}/bits/batch={batch_id}")
        if (batch_id + 1) % MERGE == 0:
            self.bits(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/merged/upto={batch_id}")
