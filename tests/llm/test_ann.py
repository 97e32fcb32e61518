import math

import numpy as np
import pytest

from labtrail.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every, k):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, set()).add(tuple(float(np.float32(x)) for x in v))
    flat = [(i, np.array(v)) for i, vs in usable.items() for v in vs]
    out = {}
    for q, qv in flat:
        if q % every == 0:
            scored = [(float(qv @ v / (np.linalg.norm(qv) * np.linalg.norm(v))), i) for i, v in flat if i != q and len(v) == len(qv)]
            out[q] = sorted(scored, key=lambda x: (-round(x[0], 12), x[1]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    hits = sum(len({x[1] for x in got[q]} & {i for _, i in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["even", "clustered", "copies"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(2000, 32))
    if kind == "clustered":
        m = m * 0.02 + rng.normal(size=(8, 32))[np.arange(2000) % 8]
    if kind == "copies":
        m[::3] = m[0]  # a third of all rows are one vector
    rows = [(int(i), [float(x) for x in m[i]], 0, "s") for i in rng.permutation(2000)]
    rows += rows[:5]
    got, want = found(A.nearest(spark.createDataFrame(rows, SCHEMA), 50, 5, shard_rows=600)), brute(rows, 50, 5)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.97
    by = dict((i, np.array([float(np.float32(x)) for x in v])) for i, v, *_ in rows)
    for q, best in got.items():
        assert [r for r, _, _ in best] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(by[q] @ by[i] / np.linalg.norm(by[q]) / np.linalg.norm(by[i]), abs=1e-14) for _, i, s in best)
        assert [(-s, i) for _, i, s in best] == sorted((-s, i) for _, i, s in best)
    if kind == "copies":
        assert [i for _, i, _ in got[0]] == [3, 6, 9, 12, 15]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0, "x"), (1, None, 0, "x"), (2, [], 0, "x"), (3, [None, 1.0], 0, "x"), (4, [nan, 1.0], 0, "x"), (5, [-inf, 1.0], 0, "x"), (6, [0.0, 0.0], 0, "x"),
        (None, [9.0, 9.0], 0, "x"), (8, [1.0, 2.0, 3.0], 0, "x"), (50, [-1.0, 0.5], 0, "x"), (100, [3e38, 3e38], 0, "x"), (150, [1.0], 0, "x"), (9, [1.0, 2.0], 0, "x"), (7, [1e-38, 0.0], 0, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = found(A.nearest(df)), brute(rows, 50, 5)
    assert 150 not in got
    for q in (0, 50, 100):
        assert [i for _, i, _ in got[q]] == [i for _, i in want[q]]
    assert A.nearest(df.limit(0)).count() == 0


def test_flat_arrays_round_trip():
    levels = A.build(np.random.default_rng(2).normal(size=(300, 8)))
    again = A.unflat(A.flat(levels))
    assert len(levels) == len(again) > 1
    for a, b in zip(levels, again):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert all((near[near >= 0] < 300).all() for _, near in levels)


def test_query_blocks_are_never_broadcast(spark):
    # a query block is sent to every shard: what Spark expects of them is a small part of what they are
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 0, "") for i, v in enumerate(rng.normal(size=(600, 8)))]
    df = A.nearest(spark.createDataFrame(rows, SCHEMA), every=5, shard_rows=100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
