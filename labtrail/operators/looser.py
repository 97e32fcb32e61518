"""Looser grouping of test names: by shape and words, not by the alias table alone.

The rule for two names is an expression over their cleaned keys.  Pairs are
formed only between distinct keys, by equality of forms, beginnings and rare
pairs of words, once for the whole vocabulary; within a scope those pairs are
edges, and their components are the groups.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions import names as nm
from labtrail.functions.basic import ladder
from labtrail.operators.dictionary import with_derived
from labtrail.operators.graph import connected
from labtrail.operators.set_join import overlap_candidates
from labtrail.operators.resolve import HELPERS, SCOPE, deduplicate, normalize_records
from labtrail.session import materialize

# fixed values: bilirubin qualifiers, in order of precedence
BILIRUBIN = ["direct", "indirect", "total", "conjugated", "unconjugated"]
OVERLAP = 0.8
PREFIX = 8


def _blocklist_key(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(key, r"[\-/,.]+", " "), r"\s+", " "))


def blocked(a: Column, b: Column) -> Column:
    """One of the pairs that must never be merged has a side in either key."""
    x, y = _blocklist_key(a), _blocklist_key(b)
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    plain = [[re.sub(r"[\-/,.]+", " ", side) for side in pair] for pair in fv.MUST_NOT_MERGE]
    holds = lambda text, part: F.contains(text, F.lit(part))
    return reduce(or_, [(holds(short, p) & holds(long, q)) | (holds(short, q) & holds(long, p)) for p, q in plain])


def _measures(key: Column) -> dict[str, Column]:
    qualifier = ladder([(F.contains(key, F.lit(q)), q) for q in BILIRUBIN], F.lit(""))
    return {
        "ratio": F.contains(key, F.lit("ratio")) | F.contains(key, F.lit("/")),
        "percent": F.contains(key, F.lit("percent")) | F.endswith(key, F.lit("%")),
        "absolute": F.rlike(key, F.lit("absolute|count|x10")),
        "bilirubin": F.contains(key, F.lit("bilirubin")),
        "qualifier": qualifier,
    }


def same_test(a: Column, b: Column) -> Column:
    """Are two cleaned keys the same test in the looser mode?"""
    x, y = _measures(a), _measures(b)
    apart = (
        blocked(a, b) | (x["ratio"] != y["ratio"]) | (x["percent"] & y["absolute"]) | (y["percent"] & x["absolute"])
        | (x["bilirubin"] & y["bilirubin"] & (x["qualifier"] != y["qualifier"]))
    )
    ca, cb = nm.compact(a), nm.compact(b)
    wa, wb = long_words(a), long_words(b)
    shared = F.size(F.array_intersect(wa, wb)) / F.least(F.size(F.array_distinct(wa)), F.size(F.array_distinct(wb)))
    overlap = (F.size(wa) >= 2) & (F.size(wb) >= 2) & (shared >= OVERLAP)
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    alike = (ca == nm.initials(b)) | (cb == nm.initials(a)) | overlap | (ca == cb) | ((F.length(short) >= PREFIX) & F.startswith(long, short))
    return (a == b) | (~apart & alike)


def long_words(key: Column) -> Column:
    return F.filter(nm.tokens(key), lambda t: F.length(t) > 2)


def same_pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a before b, of the distinct ``key`` values that are the same test.

    Each way of being alike has a join of its own, all by equality: the compact
    form of one key with the compact form or initials of the other, one key with
    the beginnings of the other, and their words by rare pairs of them.
    """
    held = materialize(keys.select("key").distinct(), "looser-keys")
    key = F.col("key")
    forms = held.select(F.col("key").alias("a"), nm.compact(key).alias("form"))
    short = held.select(F.col("key").alias("b"), F.explode(F.array_distinct(F.array(nm.compact(key), nm.initials(key)))).alias("form"))
    by_form = forms.join(short, "form").select("a", "b")
    begins = held.where(F.length(key) > PREFIX).select(key.alias("b"), F.explode(F.transform(F.sequence(F.lit(PREFIX), F.length(key) - 1), lambda n: F.substring(key, F.lit(1), n))).alias("a"))
    by_start = begins.join(held.select(F.col("key").alias("a")), "a").select("a", "b")
    worded = held.select(F.col("key").alias("id"), long_words(key).alias("words")).where(F.size("words") >= 2)
    by_words = overlap_candidates(worded, OVERLAP).select(F.col("small").alias("a"), F.col("large").alias("b"))
    pairs = by_form.unionByName(by_start).unionByName(by_words)
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(same_test(F.col("a"), F.col("b")))


def keyed(records: DataFrame) -> DataFrame:
    """Normalized records with ``key``, the cleaned form of their name."""
    return with_derived(normalize_records(records), {"Test_Name": {"key": nm.structural_clean(F.col("_key"))}})


def group_labels(rows: DataFrame, scope: str = SCOPE) -> DataFrame:
    """(scope, key, label): the first key, in text order, of the group of each key in its scope."""
    held = materialize(rows.select(scope, "key").distinct(), "scope-keys")
    pairs = materialize(same_pairs(held), "same-pairs")
    a, b = held.select(scope, F.col("key").alias("a")), held.select(scope, F.col("key").alias("b"))
    edges = a.join(pairs, "a").join(b, [scope, "b"])
    node = lambda c: F.struct(F.col(scope).alias("scope"), F.col(c).alias("key"))
    labels = connected(edges.select(node("a").alias("a"), node("b").alias("b")))
    found = labels.select(F.col("node.scope").alias(scope), F.col("node.key").alias("key"), F.col("label.key").alias("label"))
    return held.join(found, [scope, "key"], "left").withColumn("label", F.coalesce("label", "key"))


def resolve_loosely(records: DataFrame, scope: str = SCOPE) -> DataFrame:
    """Normalize, then deduplicate by looser groups."""
    rows = materialize(keyed(records), "keyed-records")
    grouped = rows.join(group_labels(rows, scope), [scope, "key"]).withColumn("_cluster", F.col("label")).drop("key", "label")
    return deduplicate(grouped, [scope]).drop(*HELPERS)
