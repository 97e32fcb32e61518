"""Extracted findings against the truth: long chains in segments equal the plain rule."""

import random
import time

import pandas as pd
import pytest

from labtrail.operators import quality as qu


def plain(extracted, truth, tol=0.01):
    """Each extracted value, in input order, takes the first unused truth within tolerance."""
    used, hits = set(), {}
    for r, n, v, p in sorted(extracted, key=lambda x: x[3]):
        for k, (r2, n2, t, _) in sorted(enumerate(truth), key=lambda x: x[1][3]):
            if k not in used and (r, n) == (r2, n2) and abs(v - t) < tol:
                used.add(k)
                hits[r] = hits.get(r, 0) + 1
                break
    return hits


@pytest.mark.parametrize("segment", [3, 100_000])
def test_segments_equal_the_plain_rule(spark, monkeypatch, segment):
    monkeypatch.setattr(qu, "SEGMENT", segment)
    rng = random.Random(segment)

    def side(n):
        return [(rng.randrange(2), rng.choice("xy"), round(rng.choice([0, 5]) + rng.random() * 0.6, 3), f"{k:05d}") for k in rng.sample(range(10 * n), n)]

    extracted, truth = side(500), side(400)
    # findings in the order of their values, so that segments wait for one another
    extracted += [(7, "z", 0.004 * k, f"{k:05d}") for k in range(200)]
    truth += [(7, "z", 0.004 * k + 0.003, f"{k:05d}") for k in range(150)] + [(7, "z", 0.1, "99999")] * 3
    schema = "report_id long, name string, value double, pos string"
    got = qu.greedy_matches(spark.createDataFrame(extracted, schema), spark.createDataFrame(truth, schema)).collect()
    assert {r.report_id: r.true_positives for r in got if r.true_positives} == plain(extracted, truth)


def test_a_long_chain_is_not_quadratic():
    n = 200_000
    rng = random.Random(1)
    # half of all findings lie within one tolerance of each other
    value = lambda: rng.random() * (0.009 if rng.random() < 0.5 else 500)
    rows = [(1, "x", 0, side, value(), k, 1, False) for side in (0, 1) for k in range(n)]
    pdf = pd.DataFrame(rows, columns=["report_id", "name", "chain", "side", "value", "pos", "copy", "beside"])
    start = time.time()
    out = qu._sweep(0.01)(None, pdf)
    assert (out.side == 0).sum() == n and out[out.side == 0].matched.sum() > 0.8 * n and time.time() - start < 60
