"""Unification of test names by similarity."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labtrail.functions import names as nm
from labtrail.operators import unify as un


def test_similarity():
    assert un.token_set_similarity("vitamin d", "vitamin d total") == 100
    assert un.token_set_similarity("a b", "b a") == 100
    assert abs(un.token_set_similarity("haemoglobin", "hemoglobin") - 100 * 20 / 21) < 1e-9
    assert un.token_set_similarity("", "x") == 0


def test_blocks_lose_no_similar_pair(spark):
    words = ["haemoglobin", "hemoglobin", "creatinine", "creatinin", "urea", "serum urea", "ldl cholesterol", "hdl cholesterol", "cholesterol", "vldl cholesterol", "tsh", "t3", "t4", "potassium", "pottasium"]
    df = spark.createDataFrame([(w,) for w in words], "name string").withColumn("key", nm.grouping_name(F.col("name")))
    keys = {r.name: r.key for r in df.collect()}
    guard = {tuple(sorted(p)) for p in itertools.permutations(["ldl cholesterol", "hdl cholesterol", "cholesterol", "vldl cholesterol"], 2)}
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if un.token_set_similarity(keys[a], keys[b]) > 90 and (a, b) not in guard}
    assert {(r.a, r.b) for r in un.similar_pairs(df).collect()} == want and ("haemoglobin", "hemoglobin") in want


def test_short_words_and_word_order_meet(spark):
    words = ["T3", "Free T3", "pH", "Urine pH", "Na", "Serum Na", "K", "a b", "b a", "x", "T4 free", ""]
    df = spark.createDataFrame([(w, w.lower()) for w in words], "name string, key string")
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if un.token_set_similarity(a.lower(), b.lower()) > 90}
    assert {(r.a, r.b) for r in un.similar_pairs(df).collect()} == want
    assert {("Free T3", "T3"), ("Urine pH", "pH"), ("Na", "Serum Na"), ("a b", "b a")} <= want


def dense(names, distance, limit):
    """Complete linkage on a full matrix, the two nearest first."""
    group = list(range(len(names)))
    between = distance.copy()
    np.fill_diagonal(between, np.inf)
    while True:
        i, j = sorted(divmod(int(np.argmin(between)), len(names)))
        if not between[i, j] < limit:
            return {n: names[g] for n, g in zip(names, group)}
        farther = np.maximum(between[i], between[j])
        between[i], between[:, i] = farther, farther
        between[i, i] = np.inf
        between[j], between[:, j] = np.inf, np.inf
        group = [i if g == j else g for g in group]


@pytest.mark.parametrize("seed", range(3))
def test_linkage_by_rounds_equals_the_dense_one(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"n{k:02d}" for k in range(45)]
    # few distinct distances, so that many are equal
    d = np.ones((45, 45))
    edges = []
    for i, j in itertools.combinations(range(45), 2):
        if rng.random() < [0.1, 0.5, 0.95][seed]:
            d[i, j] = d[j, i] = rng.integers(0, 6) / 100
            edges.append((names[j], names[i], float(d[i, j])))
    got = {r.name: r.group for r in un.complete_linkage(spark.createDataFrame(edges, "a string, b string, distance double")).collect()}
    want = dense(names, d, 0.1)
    assert all(got.get(n, n) == want[n] for n in names) and len(set(want.values())) < 40


def test_candidates_lose_no_misspelling(spark):
    rng = random.Random(2)
    words = ["blood", "serum", "total", "a", "b", "d", "t3", "haemoglobin", "cholesterol", "vitamin", "aaaaaaaa", "ratio"]
    names = set()
    for _ in range(130):
        name = " ".join(rng.sample(words, rng.randint(1, 4)))
        names.add(name)
        for _ in range(2):
            name = name or "d"
            at = rng.randrange(len(name))
            name = rng.choice([name[:at] + name[at + 1 :], name[:at] + rng.choice("abo ") + name[at:], name[:at] + rng.choice("abo") + name[at + 1 :]])
            names.add(name)
    names = sorted(n for n in names if n.strip())
    want = {(a, b) for a, b in itertools.combinations(names, 2) if un.token_set_similarity(a, b) >= 90}
    df = spark.createDataFrame([(n, n) for n in names], "name string, key string")
    found = {(r.a, r.b) for r in un.candidates(df).collect()}
    assert want <= found and len(want) > 300


def test_all_names_alike_become_the_most_frequent(spark):
    rows = [("1", "Haemoglobin", "x", "d1", "1", "p"), ("2", "Haemoglobins", "x", "d2", "900", "p"), ("3", "Haemoglobins", "x", "d3", "900", "p")]
    df = spark.createDataFrame(rows, "row_ord string, Test_Name string, Test_Category string, Test_Date string, Result string, Patient_ID string")
    assert {r.Test_Name for r in un.unify_names(df).collect()} == {"Haemoglobins"}


def test_records(spark):
    rows = [
        ("1", "Haemoglobin", "Blood", "d1", "13", "p"), ("2", "Hemoglobin", None, "d2", "14", "p"), ("3", "Haemoglobin", "N/A", "d3", "13.5", "p"), ("4", "Hemoglobin", None, "d1", "13", "p"),
        ("5", "Vitamin B-12", "Vitamins", "d1", "300", "p"), ("6", "vitamin b 12 level", None, "d2", "310", "p"),
        ("7", "Haemoglobins", None, "d1", "900", "p"), ("8", None, None, "d1", "x", "p"),
    ]
    df = spark.createDataFrame(rows, "row_ord string, Test_Name string, Test_Category string, Test_Date string, Result string, Patient_ID string")
    got = {r.row_ord: (r.Test_Name, r.Test_Category) for r in un.unify_names(df).collect()}
    assert got["1"] == got["3"] == ("Haemoglobin", "Blood") and got["2"][0] == "Haemoglobin" and "4" not in got
    assert got["5"] == got["6"] == ("Vitamin B12", "Vitamins") and got["7"][0] == "Haemoglobins" and got["8"][0] == "N/A"
