import random

import xxhash
from pyspark.sql import functions as F

from labtrail.llm import line_dedup as D


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fold(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), h)
    return signed(h)


def brute_chunks(text):
    lines = text.split("\n")
    hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
    long = [len(x.split()) > 50 for x in lines]
    marked = [fold(hashes[max(0, i - 1) : i + 1]) % 3 == 0 for i in range(len(lines))]
    parts, begin = [], 0
    for i in range(len(lines)):
        soft = marked[i] and i > 0 and not marked[i - 1] and i < len(lines) - 2
        if soft or long[i] or i + 1 == len(lines) or long[i + 1]:
            own = lines[begin : i + 1]
            parts.append(("\n".join(own), long[i], sum(x.strip(" ") != "" for x in own)))
            begin = i + 1
    out = []
    for k, (body, is_long, written) in enumerate(parts):
        unit = body if is_long or written > 1 else None
        if written == 1 and not is_long:
            if k and parts[k - 1][2]:
                unit = parts[k - 1][0] + "\n" + body
            elif not k and len(parts) > 1 and parts[1][2]:
                unit = body + "\n" + parts[1][0]
        out.append((body, unit))
    return out


def brute(docs):
    first = {}
    for key in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, signed(xxhash.xxh64_intdigest(d[1].encode(), 42)))):
        for k, (_, unit) in enumerate(brute_chunks(key[1])):
            if unit is not None:
                first.setdefault(unit, (key, k))
    out = []
    for doc_id, text in docs:
        if text is None:
            out.append((doc_id, None, 0))
            continue
        chunks = brute_chunks(text)
        kept = [t for k, (t, unit) in enumerate(chunks) if unit is None or first[unit] == ((doc_id, text), k)]
        out.append((doc_id, "\n".join(kept) if len(kept) < len(chunks) else text, len(chunks) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    lines = ["", " ", "the same line", "x", *[f"line {k} of it" for k in range(30)], *[" ".join(f"w{k}{j}" for j in range(52)) for k in range(3)]]
    passages = [[rng.choice(lines) for _ in range(rng.randint(2, 8))] for _ in range(6)]
    docs = [(None, None), (1, None), (2, ""), (2, ""), (3, "\n"), (4, "\n\n\n"), (None, "a\nb\nc\nd\ne"), (5, "a\nb\nc\nd\ne"), (5, "a\nb\nc\nd\ne")]
    for k in range(80):
        own = [f"{k} own {rng.random()}" for _ in range(rng.randint(0, 5))]
        docs.append((10 + k, "\n".join(own[:2] + rng.choice(passages) + own[2:] + rng.choice([[], rng.choice(passages)]))))
    return docs


def test_equal_to_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, removed_chars int, places string")
    out = D.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "places", "removed_chunks", "removed_chars"]
    rows = out.collect()
    assert sorted(((r.doc_id, r.text, r.removed_chunks) for r in rows), key=str) == brute(docs)
    assert sum(r.removed_chunks for r in rows) > 30 and {r.places for r in rows} == {"p"}


def test_chunks_are_the_text_and_shift_resistant(spark):
    rng = random.Random(2)
    passage = "\n".join(f"passage line {rng.random()}" for _ in range(12))
    texts = [passage, "a\n" + passage, "a\nb\nc\n" + passage + "\nd", " ".join(["long"] * 51) + "\n" + passage]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("c", D.chunks_of(F.col("text")))
    chunks = []
    for r in df.collect():
        assert "\n".join(c.text for c in r.c) == r.text
        chunks.append({c.text for c in r.c})
    # all but the chunks at the passage's ends are cut alike
    assert len(chunks[1] & chunks[0]) >= len(chunks[0]) - 2 and len(chunks[2] & chunks[0]) >= len(chunks[0]) - 2
    assert " ".join(["long"] * 51) in chunks[3]


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "x\ny\n" * 50_000)], "doc_id long, text string")
    assert D.dedup_lines(docs.limit(0)).count() == 0
    r = D.dedup_lines(docs).first()
    assert r.removed_chunks > 5_000 and r.removed_chars == len("x\ny\n" * 50_000) - len(r.text)


def test_passages_go_wherever_they_are_cut(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    docs, want = [], {}
    for k in range(60):
        each = [[30, 10, 30], [26, 26], [9] * 6, [45, 3, 3], [3, 3, 45], [7] * 8][k % 6]
        passage = [words(n) for n in each]
        for place in range(2):
            before, after = ([words(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))] for _ in range(2))
            docs.append((2 * k + place, "\n".join(before + passage + after)))
            want[2 * k + place] = "\n".join(before + (passage if place == 0 else []) + after)
    out = D.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert all((r.removed_chunks > 0) == (r.doc_id % 2 == 1) and r.removed_chars == len(docs[r.doc_id][1]) - len(r.text) for r in out)


def test_runs_end_at_long_lines_and_pass_blank_ones(spark):
    long = " ".join(["long"] * 51)
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = [(1, f"{a}\n{b}\nz1"), (2, f"x2\n{a}\n\n{b}\ny2"), (3, f"{a}\n{long}\n{b}"), (4, None), (5, ""), (6, "\n" + a)]
    out = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: "x2\ny2", 3: docs[2][1], 4: None, 5: "", 6: docs[5][1]}


def test_a_run_keeps_its_first_place_in_its_own_text(spark):
    line = " ".join(f"p{k}" for k in range(30))
    r = D.dedup_lines(spark.createDataFrame([(1, "\n".join([line] * 5))], "doc_id long, text string")).first()
    assert r.text.startswith(line + "\n" + line) or r.text == line
