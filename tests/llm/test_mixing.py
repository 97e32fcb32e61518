import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labtrail.llm import mixing as M


def u(seed, doc_id, part):
    name = "null" if doc_id is None else doc_id
    return int(hashlib.md5(f"{seed}|{name}|{part}".encode()).hexdigest()[:13], 16) / 2**52


def inverse(mean, x):
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= x and k < mean + 12 * math.sqrt(mean) + 40:
        k += 1
        p = p * mean / k
        c += p
    return k


def test_counts_equal_plain_inversion(spark):
    rows = [(k, "abc"[min(k % 6, 2)], "t", 1.5) for k in range(600)] + [(None, None, None, None), (7, "b", "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies double")
    out = M.mix(docs, {"a": 3.0, "c": 0.25}, other=0.5, seed=9)
    assert out.columns == ["doc_id", "source", "text", "copy", "copies", "shuffle_key"]
    n = Counter(r[1] for r in rows)
    weight = {"a": 3.0, "b": 0.5, "c": 0.25, None: 0.5}
    want = Counter()
    for doc_id, source, text, _ in rows:
        mean = weight[source] * len(rows) / (sum(weight.values()) * n[source])
        for k in range(inverse(mean, u(9, doc_id, 1))):
            want[doc_id, source, text, k + 1] += 1
    got = Counter((r.doc_id, r.source, r.text, r.copy) for r in out.collect())
    assert got == want and sum(got.values()) > 300


def test_shares_meet_their_weights_and_order_is_shuffled(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    out = M.mix(docs, {"small": 3.0}, epochs=2.0).collect()
    n = Counter(r.source for r in out)
    assert abs(n["small"] - 30_000) < 5 * math.sqrt(30_000) and abs(n["big"] - 10_000) < 5 * math.sqrt(10_000)
    # neighbours in the result have nothing to do with each other
    ids = [r.doc_id for r in out]
    mean = sum(ids) / len(ids)
    pairs = sum((a - mean) * (b - mean) for a, b in zip(ids, ids[1:])) / sum((a - mean) ** 2 for a in ids)
    assert abs(pairs) < 0.03


def test_large_means_and_zero_weights(spark):
    docs = spark.createDataFrame([(1, "rare"), *[(k, "often") for k in range(2, 4000)]], "doc_id long, source string")
    out = M.mix(docs, {"often": 0.0})
    n = out.count()
    assert out.select("source").distinct().collect()[0].source == "rare"
    assert abs(n - 3999) < 6 * math.sqrt(3999) and out.select("copy").distinct().count() == n
    assert M.mix(docs, {}, other=0.0).count() == 0
    assert M.mix(docs.limit(0), {"rare": 2.0}).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, {"rare": -1.0})


def test_draws_repeat(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    a = M.mix(docs, {}).collect()
    assert a == M.mix(docs.repartition(3), {}).collect() or sorted(a) == sorted(M.mix(docs.repartition(3), {}).collect())
    assert sorted(a) != sorted(M.mix(docs, {}, seed=2).collect())
