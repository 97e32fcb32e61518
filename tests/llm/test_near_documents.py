import random

import numpy as np
from pyspark.sql import functions as F

from labtrail.llm import near_documents as N

SCHEMA = "doc_id long, text string, class string, first string"


def words(text):
    return (text or "").lower().split()


def jaccard(a, b):
    def shingles(t):
        w = words(t)
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 150, 600, 2500]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            # a changed word changes five shingles of either text
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_one_of_each_group_stays(spark):
    rows = planted()
    out = {r.doc_id for r in N.keep_one(spark.createDataFrame([(*r, "c", "f") for r in rows], SCHEMA)).collect()}
    low = {i: i for i, _ in rows}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                low[y] = x
    want = {i for i, _ in rows if top(i) == i}
    # nothing clean goes, and nearly every near copy does
    assert want <= out and len(out - want) <= 0.02 * (len(rows) - len(want))


def test_edges(spark):
    rows = [
        (5, "same text here"), (3, "same text here"), (3, "same text here"), (None, "same text here"), (9, "SAME text\there"), (None, "only one without an id"),
        (10, None), (11, ""), (12, " \n"), (13, "alone"), (13, "another under this id"),
    ]
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], SCHEMA)
    out = N.keep_one(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, "same text here"), (None, "only one without an id"), (10, None), (13, "alone"), (13, "another under this id")], key=str)
    assert N.keep_one(df.limit(0)).count() == 0


def test_bags_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    met = []
    for n in (1, 3, 8, 30, 63, 64, 80, 200, 1000, 20000):
        for _ in range(30):
            both = rng.integers(0, 2**63, n, np.uint64)
            # similarity 0.8, and the sizes as far apart as it allows
            more = rng.integers(0, 2**63, n // 4, np.uint64)
            a, b = np.unique(both), np.unique(np.concatenate([both, more]))
            met.append(bool(set(N.bag_fingerprints(a)) & set(N.bag_fingerprints(b))))
    assert np.mean(met) > 0.98
    assert not set(N.bag_fingerprints(np.unique(rng.integers(0, 2**63, 400, np.uint64)))) & set(N.bag_fingerprints(np.unique(rng.integers(0, 2**63, 400, np.uint64))))


def star(variants, seed=4):
    """A text and copies of it that are nearer to it than to each other: about 0.85, and 0.73."""
    rng = random.Random(seed)
    base = [f"own{k}" for k in range(604)]
    rows = [(0, " ".join(base))]
    for n in range(1, variants + 1):
        copy = list(base)
        for k in rng.sample(range(30), 10):
            copy[20 * k + rng.randrange(8)] = f"new{n}x{k}"
        rows.append((n, " ".join(copy)))
    return rows


def test_every_two_of_a_bag_are_compared(spark):
    rows = star(300)
    assert min(jaccard(rows[0][1], t) for _, t in rows) >= 0.8 and sum(jaccard(rows[n][1], rows[n + 1][1]) >= 0.8 for n in range(1, 300)) == 0
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], SCHEMA)
    assert [r.doc_id for r in N.keep_one(df).collect()] == [0]
    # blocks smaller than the bags
    classes = df.select(F.unhex(F.md5("text")).alias("class"), "text")
    labels = N.groups(classes, block=40).collect()
    assert len(labels) == 301 and len({bytes(r.label) for r in labels}) == 1


def test_joining_pairs_reach_all_that_are_similar():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 14, 9, np.uint64)) for _ in range(120)] + [np.zeros(0, np.uint64)] * 2
    given = np.array([k if k > 20 else k % 3 for k in range(len(sets))])

    def components(pairs):
        low = given.copy()
        for i, j in pairs:
            low[low == low[j]] = low[i]
        return [frozenset(np.flatnonzero(low == g)) for g in low]

    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    found = N.joining_pairs(sets, given, 0.8)
    assert components(found) == components(alike) and len(set(components(alike))) > 2
    assert set(found) <= {p for i, j in alike for p in ((i, j), (j, i))}
