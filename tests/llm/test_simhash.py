import random
import re

import numpy as np
import pytest
import xxhash

from labtrail.llm import simhash as S
from labtrail.operators.graph import connected


def brute_fingerprint(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius):
    low = list(range(len(values)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= radius):
            a, b = sorted((top(i), top(int(j))))
            low[b] = a
    return np.array([top(i) for i in range(len(values))])


def clustered(rng, n):
    centres = rng.integers(0, 2**63, n // 12, np.uint64)
    out = []
    for c in centres:
        for _ in range(10):
            out.append(c)
            c = c ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_local_groups_equal_brute_force(radius):
    values = clustered(np.random.default_rng(radius), 3000)
    assert (S.groups_within(values, radius) == brute_groups(values, radius)).all()


def test_a_dense_ball_is_searched_exactly(monkeypatch):
    # all within three bits of one point: no vantage point splits it
    ball = np.unique(np.array([(1 << a) | (1 << b) | (1 << c) for a in range(64) for b in range(a) for c in range(0, b, 4)], np.uint64))
    flipped = []
    by_flips = S._by_flips
    monkeypatch.setattr(S, "_by_flips", lambda *a: flipped.append(1) or by_flips(*a))
    values = np.unique(np.concatenate([ball, clustered(np.random.default_rng(1), 600)]))
    assert (S.groups_within(values, 2) == brute_groups(values, 2)).all() and flipped


def test_shards_overlap_enough(spark):
    values = clustered(np.random.default_rng(8), 4000)
    points = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    got = {r.fingerprint: r.label for r in S.link(points, 2, sample=400, shard=150).collect()}
    groups = {}
    for v, g in zip(values.view(np.int64).tolist(), brute_groups(values, 2).tolist()):
        groups.setdefault(g, set()).add(v)
    linked = [g for g in groups.values() if len(g) > 1]
    assert set().union(*linked) == set(got)
    assert sorted(map(sorted, linked)) == sorted(sorted(k for k, v in got.items() if v == label) for label in set(got.values()))


def test_rows(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)] + ["É", "Straße", "ABC"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, "one"), (5, "ONE"), (6, "two words"), (6, "two words")]
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        rows += [(100 + 2 * k, " ".join(text)), (101 + 2 * k, "\n".join(text) + rng.choice(["", " more", "\x0bX"]))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, label int")
    out = S.near_duplicates(docs, sample=50, shard=20).collect()
    values = [brute_fingerprint(t) for _, t in rows]
    distinct = np.array(sorted(set(values)), np.uint64)
    group = dict(zip(distinct.tolist(), brute_groups(distinct, 2).tolist()))
    first = {}
    for (doc_id, _), v in zip(rows, values):
        if doc_id is not None:
            first[group[v]] = min(doc_id, first.get(group[v], doc_id))
    want = sorted((str(d), f"{v:016x}", first[group[v]]) for (d, _), v in zip(rows, values))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == want
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_steps_of_long_texts_give_the_same(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(5000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "STEP", 64)
    assert S.fingerprint(text) == whole == np.uint64(brute_fingerprint(text)).view(np.int64)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 150), (40, 0)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
