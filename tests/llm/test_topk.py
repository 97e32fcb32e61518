import math

import numpy as np
import pytest

from labtrail.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, block string"


def brute(rows, every, k, scale=64):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, set()).add(tuple(math.floor(scale * float(np.float32(x))) for x in v))
    flat = [(i, v) for i, vs in usable.items() for v in vs]
    out = {}
    for q, qv in flat:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in flat if i != q and len(v) == len(qv))
            out[q] = [(r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("dim", [3, 16, 40])
def test_equal_to_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in rng.normal(size=dim).round(2 if dim < 10 else 6)], 0, "b") for i in rng.permutation(500) - 30]
    rows += [(1000 + i, rows[5][1], 0, "b") for i in range(30)]  # ties
    rows += [rows[7], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(T.top_k(df, 20, 7, block_rows=90)) == brute(rows, 20, 7)


def test_pruning_keeps_exact_results():
    # long vectors among short ones: most candidates die at the first step
    rng = np.random.default_rng(0)
    m = np.floor(rng.normal(size=(4000, 64)) * np.where(rng.random(4000) < 0.02, 900, 20)[:, None])
    q = np.floor(rng.normal(size=(40, 64)) * 50)
    ids = np.arange(4000) * 3
    got = {o: (n.tolist(), s.tolist()) for o, n, s in T.search_block(ids, np.ascontiguousarray(m.T), T.rests(m), np.arange(40), q, 5)}
    for i in range(40):
        s = m @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        assert got[i] == (ids[order].tolist(), s[order].astype(int).tolist())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0, "x"), (1, None, 0, "x"), (2, [], 0, "x"), (3, [None, 1.0], 0, "x"), (4, [nan, 1.0], 0, "x"), (5, [-inf, 1.0], 0, "x"),
        (None, [9.0, 9.0], 0, "x"), (7, [0.0, 0.0], 0, "x"), (8, [1.0, 2.0, 3.0], 0, "x"), (20, [-1.0, 0.5], 0, "x"), (40, [3e38, 3e38], 0, "x"), (60, [1.0], 0, "x"),
        (9, [1.0, 2.0], 0, "x"), (0, [1.0, 2.5], 0, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 20, 3)
    got = found(T.top_k(df, 20, 3))
    assert {q: got[q] for q in (20, 40)} == {q: want[q] for q in (20, 40)} and 60 not in got
    # two vectors under id 0 share one ranking
    assert [x[0] for x in got[0]] == [1, 2, 3]
    assert T.top_k(df.limit(0)).count() == 0
