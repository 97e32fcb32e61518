import hashlib
import random
from collections import Counter

import pytest

from labtrail.llm import alignment as A


@pytest.fixture(scope="module")
def pair():
    return A.Pair(A.vocabulary("byte_bpe_50k.json"), A.vocabulary("piece_bpe_32k.model"))


def brute(pair, text):
    """Whole text, all pairs of tokens compared: (n_a, n_b, groups, links as id pairs)."""
    if not text:
        return 0, 0, None, []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    spans = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return 0, 0, None, []
        ends, at = [], 0
        for i in ids:
            ends.append((at, at + len(table[i])))
            at = ends[-1][1]
        spans.append(ends)
    groups, own = [], ([], [])
    ends = [{e for _, e in s} for s in spans]
    for at in sorted(ends[0] & ends[1]):
        cut = [[i for i, (_, e) in zip(ids, s) if e <= at][done:] for ids, s, done in zip((a, b), spans, (sum(map(len, own[0])), sum(map(len, own[1]))))]
        own[0].append(cut[0])
        own[1].append(cut[1])
        groups.append(f"{','.join(map(str, cut[0]))}|{','.join(map(str, cut[1]))}")
    links = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (t, f) in zip(b, spans[1]) if s < f and t < e]
    return len(a), len(b), groups, links


def texts():
    rng = random.Random(9)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", ";\r", "word's", "1234", "é", "漢字", "🙂", " ", "　", " ", "\x1c", "\x85", "​", "﻿", "\x00", "▁", "<|endoftext|>", "</s>", "<0x0A>",
             "ing", ".", "...", "thonanea", "ciónrauedo", "{\r", "­", "ﬁ", "\v", "\f", "᠎", "don't", "A", " B"]
    fixed = [None, "", " ", "\n", "  \n ", "a " * 3000, "x" * 3000, "▁", "word ▁ word", "a\n b\n  c \n", "tab\t"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]


def test_texts_equal_brute_force(pair):
    for text in texts():
        n_a, n_b, groups, links = brute(pair, text)
        got = pair([text or ""])[0]
        told = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert got[:5] == (n_a, n_b, len(groups or []), len(links), told), text
        assert Counter({(int(p) & 0xFFFFFFFF, int(p) >> 32): int(n) for p, n in zip(got[5], got[6])}) == Counter(links), text


def test_corpus_counts(spark, pair):
    rows = [(k if k % 5 else None, t, "x") for k, t in enumerate(texts()[:150])]
    rows += rows[11:31] + [(900 + k, "the same text, word for word", "x") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string")
    whole = [brute(pair, t) for _, t, _ in rows]
    counts = Counter(link for *_, links in whole for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for (doc_id, _, _), (n_a, n_b, groups, links) in zip(rows, whole):
        told = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want.append((doc_id, n_a, n_b, len(groups or []), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), told))
    got = A.align_tokens(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_rare_pairs_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word number {k % 7} of {k}") for k in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, A.align_tokens(docs).collect()))
    monkeypatch.setattr(A, "FREQUENT", 12)
    assert sorted(map(tuple, A.align_tokens(docs).collect())) == want
    monkeypatch.setattr(A, "FREQUENT", 0)
    assert sorted(map(tuple, A.align_tokens(docs).collect())) == want


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a " * 100_000)], "doc_id long, text string")
    rows = A.align_tokens(docs).collect()
    assert sorted((r.n_a, r.groups_sha256 == "") for r in rows)[:3] == [(0, True)] * 3 and len(rows) == 4
    assert A.align_tokens(docs.limit(0)).count() == 0
