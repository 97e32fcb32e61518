import random
import re
import zlib
from collections import Counter

import pytest

from labtrail.llm import variants as V


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    alphabet = "abÀéz"
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    docs = [(None, None), (1, ""), (2, "12 ×÷ --"), (3, "É" * 7 + " short "), (3, "É" * 7 + " short ")]
    for k in range(300):
        words = []
        for _ in range(60):
            w = stems[int(len(stems) * rng.random() ** 3)]
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        docs.append((k if k % 9 else None, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs


def test_equal_to_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = V.group_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 100 and sum(r[1] is not None for r in want) > 30
    assert V.group_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1, 5])
def test_split_signatures_lose_no_pair(spark, group):
    rng = random.Random(group)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(500)} | {"a" * 250, "a" * 251, "a" * 100 + "b" + "a" * 149, "a" * 249 + "b"})
    got = V.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), group).collect()
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_apart(a, b)}
    assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want)


def test_signatures_of_sets_that_differ_little():
    rng = random.Random(1)
    for k, first, second in [V.SAME_LENGTH, V.ONE_LONGER, (2, 3, 1), (2, 2, 3), (3, 2, 4)]:
        made = V.PartEnum(k, first, second)
        for _ in range(300):
            bits = {rng.getrandbits(64) for _ in range(rng.randint(1, 12))}
            other = bits ^ {rng.choice([*bits, rng.getrandbits(64)]) for _ in range(k)}
            assert set(made(list(bits), 3)) & set(made(list(other), 3))
    with pytest.raises(ValueError):
        V.PartEnum(2, 1, 2)


def test_cuts_of_long_words(spark):
    assert len(V.without_a_letter("a" * 100_000, 2)) == 2
    text = " ".join(["a" * 100_000] * 5 + ["a" * 99_999] * 25)
    rows = {len(r.word): r for r in V.group_variants(spark.createDataFrame([(-1, text)], "doc_id long, text string")).collect()}
    assert len(rows[100_000].form) == 99_999 and rows[99_999].form is None


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(12)], "word string, form string")
    got = {r.word: r.root for r in V.roots(links, 5**13).collect()}
    assert got == {f"w{k}": "w12" for k in range(12)}
