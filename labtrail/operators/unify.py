"""Unification of test names by string similarity.

Names are compared once for the whole vocabulary.  Candidates are pairs of
distinct names that share a rare part, by prefix filters that lose no name of a
similarity over the threshold (``candidates``); each gets a token-set
similarity.  Names are then grouped by complete linkage over the sparse table of
similar pairs: in each round every two groups that are nearest to each other are
joined, which gives what joining the two nearest of all gives, as a group is
never nearer to others than its parts were.  Names whose typical result is far
from their group's leave it, and every name becomes the most frequent one of its
group.  If all names are similar, all become the most frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions import names as nm
from labtrail.functions import values as va
from labtrail.operators.quality import exact_percentile
from labtrail.operators.resolve import ORDER
from labtrail.operators.set_join import weighted_prefix
from labtrail.session import materialize

THRESHOLD = 90.0
#: A name leaves its group if its median differs from the group's by more than this share.
FAR = 0.3
LIPOPROTEINS = ["hdl", "ldl", "vldl"]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_similarity(a: str, b: str) -> float:
    """Similarity of two names as sets of words, 0 to 100: the best of comparing
    the shared words and what either name adds to them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    whole_x, whole_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = _ratio(whole_x, whole_y)
    return max(best, _ratio(both, whole_x), _ratio(both, whole_y)) if both else best


def _kept_apart(a: Column, b: Column) -> Column:
    """Different lipoproteins, or one of them and cholesterol in general."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w))
    kind = lambda c: has(c, "hdl") | has(c, "ldl")  # noqa: E731  vldl holds ldl
    general = lambda c: has(c, "cholesterol") & ~kind(c)
    apart = (kind(a) & general(b)) | (kind(b) & general(a))
    for w in LIPOPROTEINS:
        for v in LIPOPROTEINS:
            if v != w:
                apart = apart | (has(a, w) & has(b, v))
    return apart


def _numbered(parts: Column) -> Column:
    """The parts of an array, each with how often it stood before: a multiset as a set."""
    return F.transform(parts, lambda x, i: F.concat_ws("\x00", x, F.size(F.filter(F.slice(parts, F.lit(1), i), lambda y: y == x)).cast("string")))


def _grams(words: Column, q: int) -> Column:
    cut = lambda w: F.when(F.length(w) >= q, F.transform(F.sequence(F.lit(1), F.length(w) - q + 1), lambda i: w.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, cut))


def candidates(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a before b, of names that may be as similar as ``threshold``; ``names`` has name and key.

    Similar names are so in one of two ways.  Either the words they share are
    nearly all of one name: the others have a small share of its characters, so
    among its rarest words of just more weight than that, one is shared.  Or
    what they add to the shared words differs in few letters (``edits``): each
    changes at most q of a name's q-letter parts and at most one word, so one
    more of its rarest parts, or of its rarest words, must be shared.  Three
    letters are used, or words, or two letters, as soon as a name has enough of
    them; it can't be short of all.
    """
    e = 1 - threshold / 100
    words = F.array_sort(F.array_distinct(F.filter(F.split("key", r"\s+"), lambda w: w != "")))
    held = names.select("name", words.alias("words")).where(F.size("words") > 0)
    held = held.withColumn("edits", F.floor(2 * e / (1 - e) * F.length(F.array_join("words", " ")) + 1e-9).cast("int"))
    kinds = {"w": F.col("words"), "3": _numbered(_grams(F.col("words"), 3)), "2": _numbered(_grams(F.col("words"), 2))}
    listed = F.flatten(F.array(*[_tagged(kind, parts) for kind, parts in kinds.items()]))
    every = materialize(held.select("name", "words", "edits", F.explode(listed).alias("part")), "name-parts")
    known = materialize(every.groupBy("part").agg(F.count("*").alias("names")), "part-counts")
    kind = F.substring("part", 1, 1)
    of = lambda k: F.array_sort(F.collect_list(F.when(kind == k, F.struct("names", "part"))))
    ranked = every.join(known, "part").groupBy("name", "edits").agg(*[of(k).alias(f"of{k}") for k in kinds])
    parts = lambda c: F.transform(F.col(c), lambda x: x["part"])
    # of its own characters, a name may lack this many if the shared ones are to be similar to it
    spare = (e / (2 - threshold / 100)) * 2
    length = F.aggregate(F.col("ofw"), F.lit(0), lambda acc, x: acc + F.length(x["part"])) - 1
    heavy = weighted_prefix(F.transform("ofw", lambda x: (F.length(x["part"]) - 1).cast("double")), length * spare)
    few = lambda c, n: F.slice(parts(c), F.lit(1), n)
    enough = lambda c, q: F.size(c) >= q * F.col("edits") + 1
    close = F.when(enough("of3", 3), few("of3", 3 * F.col("edits") + 1)).when(enough("ofw", 1), few("ofw", F.col("edits") + 1)).otherwise(few("of2", 2 * F.col("edits") + 1))
    prefix = ranked.select(F.col("name").alias("a"), F.explode(F.array_union(few("ofw", F.greatest(heavy, F.lit(1))), close)).alias("part"))
    pairs = prefix.join(every.select(F.col("name").alias("b"), "part"), "part").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tagged(kind: str, parts: Column) -> Column:
    return F.transform(parts, lambda x: F.concat(F.lit(kind), x))


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a before b, of the names at least as similar as ``threshold``; ``names`` has name and key."""
    keys = names.select("name", "key")
    pairs = candidates(names, threshold).where(~_kept_apart(F.col("a"), F.col("b")))
    pairs = pairs.join(keys.toDF("a", "x"), "a").join(keys.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["similarity"] = [token_set_similarity(x, y) for x, y in zip(pdf.x, pdf.y)]
            yield pdf[["a", "b", "similarity"]]

    return pairs.mapInPandas(scored, "a string, b string, similarity double").where(F.col("similarity") >= threshold)


def complete_linkage(edges: DataFrame) -> DataFrame:
    """(name, group) of all names of ``edges`` (a, b, distance; each pair once): groups in which every pair has an edge.

    The two nearest groups are joined, those of the smallest names if several
    are, until no two groups have all their pairs among the edges; a group is
    named by its smallest name.  Done by rounds over the table: two groups that
    are nearest to each other by that order are joined at once.  An edge between
    joined groups stays if all its parts had one, at the largest distance.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"), "linkage-edges")
    groups = now.select(F.col("a").alias("name")).union(now.select("b")).distinct().withColumn("group", F.col("name"))
    while not now.isEmpty():
        key = F.struct("distance", "a", "b")
        ends = now.select(F.explode(F.array("a", "b")).alias("g"), key.alias("e"))
        best = ends.groupBy("g").agg(F.min("e").alias("e"))
        joined = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select(F.col("e.b").alias("old"), F.col("e.a").alias("new"))
        joined = materialize(joined, "linkage-joins")
        # both sides of a join have a part of each of its edges
        parts = joined.select(F.explode(F.array("old", "new")).alias("old"), "new")
        sized = lambda c: parts.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
        moved = now.join(sized("a"), "a", "left").join(sized("b"), "b", "left").select(
            F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"), "distance",
            (F.when(F.col("a_new").isNotNull(), 2).otherwise(1) * F.when(F.col("b_new").isNotNull(), 2).otherwise(1)).alias("needed"),
        ).where("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("distance").alias("distance"), F.count("*").alias("n"), F.max("needed").alias("needed"))
        now = materialize(moved.where("n = needed").select("a", "b", "distance"), "linkage-edges")
        groups = materialize(groups.join(joined.toDF("group", "to"), "group", "left").select("name", F.coalesce("to", "group").alias("group")), "linkage-groups")
    return groups


def with_plain_names(records: DataFrame) -> DataFrame:
    """Records with one name for all spellings of vitamin B12, and N/A for none."""
    b12 = F.col("Test_Name").isin(*fv.B12_VARIANTS)
    return records.withColumn("Test_Name", F.when(b12, fv.B12_TARGET).otherwise(F.coalesce("Test_Name", F.lit("N/A"))))


def name_facts(rows: DataFrame) -> DataFrame:
    """(name, n, first, median, key) of every name: its rows, its first place, and its exact median result."""
    counted = rows.groupBy(F.col("Test_Name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("first"))
    numbers = rows.select(F.col("Test_Name").alias("name"), va.strict_numeric(F.col("Result")).alias("value"))
    medians = exact_percentile(numbers, "name", "value", 0.5).withColumnRenamed("p", "median")
    return counted.join(medians, "name", "left").withColumn("key", nm.grouping_name(F.col("name")))


def frequent_categories(rows: DataFrame) -> DataFrame:
    """(Test_Name, _mode): the most frequent category of each test that has one; the first in text order of several."""
    votes = rows.where(F.col("Test_Category").isNotNull() & (F.col("Test_Category") != "N/A")).groupBy("Test_Name", "Test_Category").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("Test_Name").agg(F.min_by("Test_Category", F.struct(-F.col("n"), F.col("Test_Category"))).alias("_mode"))


def unify_names(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Records under unified names, categories filled in, repeats left out.

    Spellings of vitamin B12 are one name.  A missing category becomes the most
    frequent one of its test.  Of rows equal in name, date, result and patient
    the first stays."""
    rows = with_plain_names(records)
    modes = frequent_categories(rows)
    facts = materialize(name_facts(rows), "name-facts")
    pairs = materialize(similar_pairs(facts.select("name", "key"), threshold), "similar-names")
    n = facts.count()
    if 2 * pairs.count() == n * (n - 1):
        placed = facts.withColumn("group", F.lit(""))
    else:
        edges = pairs.where(F.col("similarity") > threshold).select("a", "b", (1 - F.col("similarity") / 100).alias("distance"))
        grouped = facts.join(complete_linkage(edges), "name")
        middle = grouped.groupBy("group").agg(F.median("median").alias("middle"))
        far = (F.col("middle") > 0) & (F.abs(F.col("median") - F.col("middle")) / F.col("middle") > FAR)
        placed = grouped.join(middle, "group").withColumn("group", F.when(far, F.concat(F.lit("\u0000"), "name")).otherwise(F.col("group")))
    best = placed.groupBy("group").agg(F.min_by("name", F.struct(-F.col("n"), F.col("first"))).alias("_unified"))
    names = placed.join(best, "group").select(F.col("name").alias("Test_Name"), "_unified")
    out = rows.join(modes, "Test_Name", "left").join(names, "Test_Name", "left")
    missing = F.col("Test_Category").isNull() | (F.col("Test_Category") == "N/A")
    out = out.withColumn("Test_Category", F.when(missing, F.coalesce("_mode", "Test_Category")).otherwise(F.col("Test_Category")))
    out = out.withColumn("Test_Name", F.coalesce("_unified", "Test_Name")).drop("_unified", "_mode")
    keys = ["Test_Name", "Test_Date", "Result", "Patient_ID"]
    # a rank, not an aggregate of whole rows: columns that nobody reads are not shuffled
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ORDER).asc_nulls_last()))
    return out.withColumn("_place", first).where("_place = 1").drop("_place")
