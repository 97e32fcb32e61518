"""Joins of sets of words by what they share, without a block of all sets that hold a common word.

Two sets match if they share at least ``share`` of the smaller one.  With ``m``
words in the smaller set, ``t = ceil(share * m)`` of them are shared, so of its
``m - t + 2`` rarest words at least two are.  The smaller set is listed under
the pairs of those, the other one under all pairs of its words, and an equi join
of both lists finds every match.  As rare words are taken first, a pair of
common words lists only the few small sets that have nothing rarer.

Sets of one word, and sets of over ``MOST_PAIRED`` words, whose pairs would be
too many, are listed by single words instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.session import materialize

MOST_PAIRED = 48


def ranked_words(sets: DataFrame) -> DataFrame:
    """(id, words): the distinct words of each set, rarest first; ``sets`` has distinct ``id`` and ``words``."""
    each = sets.select("id", F.explode(F.array_distinct("words")).alias("word"))
    known = materialize(each.groupBy("word").agg(F.count("*").alias("sets")), "word-counts")
    rare = F.array_sort(F.collect_list(F.struct("sets", "word")))
    return each.join(known, "word").groupBy("id").agg(F.transform(rare, lambda x: x["word"]).alias("words"))


def _pairs(words: Column) -> Column:
    """The unordered pairs of an array's words."""
    both = lambda x, y: F.concat_ws("\x00", F.least(x, y), F.greatest(x, y))
    return F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: both(x, y))))


def _named(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def overlap_candidates(sets: DataFrame, share: float) -> DataFrame:
    """(small, large): ids of every two sets that may share ``share`` of the smaller; of equal sets in size both orders."""
    ranked = materialize(ranked_words(sets), "ranked-words").withColumn("n", F.size("words"))
    spare = F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int")
    w = F.col("words")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    rarest = lambda k: F.slice(w, F.lit(1), F.least(spare + k, F.col("n")))
    small = F.when(F.col("n") == 1, _named("one", w)).otherwise(F.concat(_named("two", _pairs(rarest(2))), _named("long", rarest(1))))
    paired = F.col("n") <= MOST_PAIRED
    large = F.concat(_named("one", w), F.when(paired, _named("two", _pairs(w))).otherwise(none), F.when(~paired, _named("long", w)).otherwise(none))
    a = ranked.select(F.col("id").alias("small"), F.col("n").alias("m"), F.explode(small).alias("key"))
    b = ranked.select(F.col("id").alias("large"), "n", F.explode(large).alias("key"))
    return a.join(b, "key").where("m <= n and small <> large").select("small", "large").distinct()


def weighted_prefix(weights: Column, spare: Column) -> Column:
    """How many leading words of an array a set must be listed under, if words of at most ``spare`` weight may differ."""
    step = lambda acc, x: F.when(acc["w"] > spare, acc).otherwise(F.struct((acc["w"] + x).alias("w"), (acc["k"] + 1).alias("k")))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("k"))
    return F.aggregate(weights, start, step, lambda acc: acc["k"])
