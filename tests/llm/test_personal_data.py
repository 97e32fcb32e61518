import hashlib
import random
import re

import pytest

from labtrail.llm import personal_data as P

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
            if kind == 1 and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_search():
    rng = random.Random(5)
    parts = ["a@b.co", "@", ".", "-", " ", "1", "23", "255", "256", "4539578763621486", "+1 (555) 010-2030", "10.0.0.1", "x_", "é", "@@", "\n", "0049"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert P.plain_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["+1  2  3  4  5  6  7  8  9  0", "+1)(2)(3)(4)(5)(6)(7)(8)(9)(0", "a@b-c +1--2--3--4--5--6--7--8--9--0"])
def test_phone_digits_far_apart(text):
    assert P.plain_spans(text) == brute(text) and len(brute(text)) == 1


@pytest.mark.parametrize("text, want", [
    ("write to jane.doe [at] mail [dot] org now", ["jane.doe [at] mail [dot] org"]),
    ("write to jane dot doe at mail dot example dot org now", ["jane dot doe at mail dot example dot org"]),
    ("ｊａｎｅ＠ｍａｉｌ．ｏｒｇ", ["ｊａｎｅ＠ｍａｉｌ．ｏｒｇ"]),
    ("jаne@mаil.org", ["jаne@mаil.org"]),
    ("ja​ne@mail.org", None),
    ("card four five three nine 5787 6362 one four eight six", ["four five three nine 5787 6362 one four eight six"]),
    ("host 10 dot 0 dot 0 dot 1", ["10 dot 0 dot 0 dot 1"]),
    ("call +1 five five five 010 2030", ["+1 five five five 010 2030"]),
    ("a stop at noon. one two three dots", []),
    ("", []), ("at dot at dot", []), ("look at this dot", []),
])
def test_disguises_map_back(text, want):
    base = P.plain_spans(text)
    got = [text[s:e] for s, _, e in P.added_spans(text, base)]
    if want is not None:
        assert got == want
    for s, e in [(s, e) for s, _, e in P.added_spans(text, base)]:
        assert not any(b < e and s < c for b, _, c in base)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "@", "a@", "1 ", "+1", " dot a", " at a", "one ", "(at)"):
        text = unit * (200_000 // len(unit))
        P.added_spans(text, P.plain_spans(text))


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "a@b.co", "x"), (3, "a@b.co", "x"), (4, "é a@b.co 10.0.0.1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = P.find(docs).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in out) == [
        ("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 1, 0, "email:0:6"), ("3", 1, 0, "email:0:6"),
        ("4", 1, 1, "email:2:8,ip:9:17"), ("None", 1, 0, "email:0:6"),
    ]
    by = {r.doc_id: r for r in out}
    assert by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert [e.value for e in by[4].entities] == ["a@b.co", "10.0.0.1"]
    assert P.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("disguise", [
    "jane [at] example dot com", "jane@example dot com", "jane at example.com", "jane at example [dot] com", "jane(at)example.com",
    "jane dot doe [at] mail.example dot com", "jane [dot] doe at mail dot example.com", "10 [dot] 0 dot 0.1",
])
def test_mixed_disguises(disguise):
    text = f"write to: {disguise}, now"
    assert [text[s:e] for s, _, e in P.added_spans(text, P.plain_spans(text))] == [disguise]


@pytest.mark.parametrize("text", ["it began at 10.30 or at v1.2", "at example.com", "jane@example.com dot com", "we sat at home. Then left"])
def test_no_disguise(text):
    assert P.added_spans(text, P.plain_spans(text)) == []


def test_mixed_marks_take_linear_time():
    for unit in (" at a.b", "@a dot b", " at at dot", "a.", " dot at", "[at]a dot b", " at a dot "):
        text = unit * (200_000 // len(unit))
        P.added_spans(text, P.plain_spans(text))


def test_long_runs_of_digits(spark):
    texts = ["0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1", "+" + "1 " * 5000 + "2", "7" * 20_000, "one " * 6000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in P.find(docs).collect()}
    assert rows[0].spans == "ip:0:5006" and not any(rows[k].spans for k in (1, 2, 3))
