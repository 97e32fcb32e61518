"""Mixing sources to target weights by Poisson replication.  DataFrame functions only.

Each source has a target weight.  The mean rate at which its documents are to be
repeated is its target share over its actual share.  A document draws its number
of copies from the Poisson distribution of that mean, by inverting it at a
uniform number hashed from the seed and the document's id: the draw is the same
whenever and wherever it is made.  Documents are exploded by their counts, and
the copies are dealt out and ordered by a hash of seed, id and copy, which
shuffles them globally.

Only counts per source are aggregated (summed within tasks first, so a source
with most of the rows is no hot spot).  Their table, with the cumulative
probabilities, is written before it is joined: Spark then knows its size and
sends it to the executors if it is under the broadcast threshold, or else joins
by a shuffle of which AQE splits the hot sources.  A mean above ``LARGEST_MEAN``
is drawn as a sum of several smaller ones, as e to its negative is 0 in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import free_name, materialize

LARGEST_MEAN = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def cumulative(mean: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until what is left can't be told from 0."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    begin = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def more(acc: Column, k: Column) -> Column:
        p = acc.p * mean / k
        return F.struct(p.alias("p"), F.concat(acc.c, F.array(F.element_at(acc.c, -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, more, lambda acc: acc.c)


def rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float) -> DataFrame:
    """Per source: its rows, the mean repetition rate, in how many parts it is drawn, and the parts' cumulative probabilities."""
    weight = F.lit(float(other))
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    counted = materialize(docs.groupBy("source").agg(F.count("*").alias("rows")).withColumn("weight", weight), "source-counts")
    total = counted.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).first()
    if not total.weight:
        mean = F.lit(0.0)
    else:
        mean = F.col("weight") * F.lit(float(total.rows) * epochs) / (F.lit(float(total.weight)) * F.col("rows"))
    table = counted.withColumn("mean", mean).withColumn("parts", F.greatest(F.ceil(F.col("mean") / LARGEST_MEAN), F.lit(1)).cast("int"))
    return materialize(table.withColumn("cumulative", cumulative(F.col("mean") / F.col("parts"))), "source-rates")


def mix(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epochs: float = 1.0, seed: int = 1) -> DataFrame:
    """Copies of the rows of ``docs``, shuffled, with ``copy`` (from 1), ``copies`` and ``shuffle_key``.

    ``weights`` gives the target weight of named sources, ``other`` that of
    each source not named (a null source is one of these).  The expected number
    of rows is ``epochs`` times those of ``docs``; the expected share of a
    source is its weight over the sum of the weights of all sources present.
    A source of weight 0 goes.  ``docs`` needs ``doc_id`` and ``source``; all
    other columns stay, and ones named like a new column are replaced.  Rows of
    the same doc_id (null counts as one) draw the same number.  An empty table
    gives no rows.
    """
    if min([other, *weights.values()]) < 0:
        raise ValueError("weights can't be negative")
    docs = docs.drop("copy", "copies", "shuffle_key")
    own = {c: free_name(docs, c) for c in ("rate_source", "parts", "cumulative")}
    table = rates(docs, weights, other, epochs).select(
        F.col("source").alias(own["rate_source"]), F.col("parts").alias(own["parts"]), F.col("cumulative").alias(own["cumulative"])
    )

    def drawn(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("doc_id"), part)
        return F.aggregate(F.array(u), F.lit(0), lambda acc, x: F.size(F.filter(own["cumulative"], lambda c: c <= x)))

    met = docs.join(table, F.col("source").eqNullSafe(F.col(own["rate_source"])), "inner")
    counted = met.withColumn("copies", F.aggregate(F.sequence(F.lit(1), F.col(own["parts"])), F.lit(0), lambda acc, part: acc + drawn(part)).cast("long"))
    copied = counted.where("copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "copies")
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    keyed = copied.withColumn("shuffle_key", F.substring(digest, 1, 16))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
