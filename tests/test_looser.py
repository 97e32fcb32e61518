"""Looser grouping of test names."""

import random

from pyspark.sql import functions as F

from labtrail.functions import names as nm
from labtrail.operators import looser as lo
from labtrail.operators import set_join as sj
from labtrail.operators.graph import connected

NEVER = [("Albumin", "Albumin/Globulin Ratio (A/G)"), ("Bilirubin Total", "Bilirubin Indirect"), ("TSH", "T3"), ("TSH", "T3H")]
SAME = [("Serum Creatinine Level", "creatinine serum level"), ("Haemoglobin A1c", "haemoglobin a1c (blood)"), ("C-Reactive Protein", "crp"), ("Vitamin B12", "vitamin b 12"), ("Cholesterol", "Cholesterol Total Serum")]
APART = [("Lymphocytes %", "Lymphocytes Absolute Count"), ("Urea", "Urea Creatinine Ratio"), ("Bilirubin", "Bilirubin Direct"), ("Sodium", "Potassium")]


def test_pairs(spark):
    rows = [(a, b, want) for pairs, want in ((NEVER, False), (SAME, True), (APART, False)) for a, b in pairs]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    for c in "ab":
        df = df.withColumn(c, nm.structural_clean(F.col(c)))
    out = df.withColumn("got", lo.same_test(F.col("a"), F.col("b"))).withColumn("back", lo.same_test(F.col("b"), F.col("a"))).collect()
    assert [(r.a, r.b) for r in out if r.got != r.want or r.back != r.want] == []


def test_blocks_lose_no_pair(spark):
    words = ["serum", "total", "creatinine", "level", "urea", "c", "crp", "reactive", "protein", "b12", "b", "12", "vitamin", "%", "ratio"]
    keys = [(" ".join([words[i % 15], words[(i * 7 + 3) % 15], words[(i * 11 + i // 15) % 15]][: 1 + i % 3]),) for i in range(200)]
    df = spark.createDataFrame(keys, "key string").distinct()
    every = df.select(F.col("key").alias("a")).join(df.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    want = {tuple(r) for r in every.where(lo.same_test(F.col("a"), F.col("b"))).collect()}
    assert {tuple(r) for r in lo.same_pairs(df).collect()} == want and len(want) > 20


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 51), (7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 51: 50}


def test_a_word_in_a_third_of_the_names_makes_no_block(spark):
    """Candidates of names that share common words only are few, and none that match are lost."""
    rng = random.Random(6)
    rare = [f"w{k}x" for k in range(120)]
    names = {" ".join(rng.sample(["serum", "total", "blood"], rng.choice([0, 1, 1, 2])) + rng.sample(rare, rng.randint(1, 4))) for _ in range(900)}
    names |= {"serum", "serum serum", "serum total", "total blood serum", " ".join(rare[:60]), " ".join(rare[1:61])}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "key string")
    want = {(a, b) for a in names for b in names if a < b and overlap(a, b)}
    sets = df.select(F.col("key").alias("id"), F.split("key", " ").alias("words"))
    found = {tuple(sorted((r.small, r.large))) for r in sj.overlap_candidates(sets, lo.OVERLAP).collect()}
    assert want <= found and len(want) > 100
    # all pairs that share "serum" would be some forty thousand
    assert len(found) < 4 * len(want)
    every = df.select(F.col("key").alias("a")).join(df.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    assert {tuple(r) for r in lo.same_pairs(df).collect()} == {tuple(r) for r in every.where(lo.same_test(F.col("a"), F.col("b"))).collect()}


def overlap(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / min(len(x), len(y)) >= lo.OVERLAP
