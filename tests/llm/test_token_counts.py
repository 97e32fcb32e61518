import random

import pytest

from labtrail.llm import token_counts as T


def pieces(text):
    """Spans by decoding: the characters that each token's bytes begin, or are in."""
    import public_tokenizers

    encoding, _ = T._encoding(T.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    first = [k == 0 for c in text for k, _ in enumerate(c.encode())]
    at, spans = 0, []
    for i in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(i))
        begun = [owner[b] for b in range(at, at + n) if first[b]]
        chars = {owner[at], *begun} if begun and not first[at] else set(begun) or {owner[at]}
        spans.append((min(chars), max(chars) + 1))
        at += n
    return spans


def brute(text, sections, rule):
    counts = [0.0] * len(sections)
    for s, e in pieces(text):
        shares = [max(0, min(e, b) - max(s, a)) for a, b in sections]
        if sum(shares) == 0:
            continue
        if rule == "share":
            counts = [c + x / (e - s) for c, x in zip(counts, shares)]
        elif rule == "most":
            counts[shares.index(max(shares))] += 1
        else:
            for k, (a, b) in enumerate(sections):
                counts[k] += a <= s < b
    return counts


@pytest.mark.parametrize("rule", T.RULES)
def test_counts_equal_brute_force(spark, rule):
    rng = random.Random(3)
    parts = ["the ", "word", "\n", "\n\n", "  ", "é", "漢字", "🙂", "x" * 9, "1234", "ing"]
    rows = []
    for k in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
        spans = list(zip(cuts[::2], cuts[1::2]))
        rows.append((k, text, [(f"n{a}", a, b) for a, b in spans]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fields array<struct<name:string,start:int,end:int>>")
    given, lines = {}, {}
    for r in T.count_tokens(docs, "fields", rule).collect():
        given.setdefault(r.doc_id, {})[r.section] = r
    for r in T.count_tokens(docs, None, rule).collect():
        lines.setdefault(r.doc_id, {})[r.section] = r
    for k, text, fields in rows:
        want = brute(text, [f[1:] for f in fields], rule)
        assert [given[k][i].tokens for i in range(len(fields))] == pytest.approx(want)
        assert given[k][None].tokens + sum(want) == pytest.approx(len(pieces(text)))
        own = [lines[k][i] for i in range(len(lines[k]))]
        assert "".join(text[r.start : r.end] for r in own) == text
        assert [r.tokens for r in own] == pytest.approx(brute(text, [(r.start, r.end) for r in own], rule))
        assert sum(r.tokens for r in own) == pytest.approx(len(pieces(text))) and own[0].doc_tokens == len(pieces(text))


def test_edges(spark):
    rows = [(None, None, "n"), (1, "", "n"), (1, "", "n"), (2, "a " * 200_000, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = T.count_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.tokens) for r in out)[:3] == [("1", 0), ("1", 0), ("2", 200_001)] and len(out) == 4
    assert T.count_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(docs, rule="other")
