"""Guideline retrieval against a plain loop, over a knowledge table that isn't the built-in one."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.operators import chat as ch
from labtrail.operators import guidelines as gl


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9%+\-\s]", " ", text.lower())).strip()


def plain(query, findings, entry, months):
    q, told = norm(query or ""), []
    names, keys, related = ([norm(x) for x in entry.get(k) or []] for k in ("names", "keywords", "related"))
    names += [norm(x) for x in entry.get("aliases") or []]
    for f in map(norm, findings or []):
        for n in names:
            if f and n and (f in n or n in f):
                told.append((28, n, "exact active finding match") if f == n else (18, n, "partial active finding match"))
        told += [(9, r, "related test proximity") for r in related if f and r and (f in r or r in f)]
    told += [(20, n, "query includes canonical test alias") for n in names if n and n in q]
    told += [(8, k, "query keyword match") for k in keys if k and k in q]
    tokens = [t for t in q.split(" ") if len(t) > 1 and t not in fv.STOP_WORDS]
    tokens = list(dict.fromkeys(tokens + [norm(x) for t in tokens for x in fv.CONCEPT_EXPANSIONS.get(t, [])]))
    told += [(3, t, None) for t in tokens if len(t) > 1 and any(t in x for x in names + keys)]
    for kind, (column, points, why) in gl.INTENTS.items():
        if any(t in q for t in fv.INTENT_TERMS[kind]) and entry.get(column) != []:
            told.append((points, None, why))
    score = sum(p for p, _, _ in told) + {"A": 2, "B": 1}.get(entry["level"], 0) + (3 if months <= 12 else 2 if months <= 24 else 1 if months <= 36 else 0)
    return score, list(dict.fromkeys(t for _, t, _ in told if t)), [w for _, _, w in told if w]


ENTRIES = [
    {"id": "a", "category": "x", "names": ["Iron", "Serum Iron"], "aliases": ["fe"], "keywords": ["anemia", "iron stores"], "related": ["ferritin"], "level": "A", "updated": "2024-01", "title": "Iron", "content": "All about iron.", "trend_signals": []},
    {"id": "b", "category": "x", "names": ["Ferritin"], "aliases": ["ferritin", ""], "keywords": ["iron"], "related": ["Iron", "tibc"], "level": "B", "updated": "2022-11"},
    {"id": "c", "category": "y", "names": ["HbA1c"], "aliases": None, "keywords": ["sugar", "glucose"], "related": None, "level": "C", "updated": "2019"},
    {"id": "d", "category": "y", "names": ["glucose (fasting)"], "aliases": [], "keywords": [], "related": ["hba1c"], "level": "A", "updated": "2024-05", "escalation_triggers": [], "actions": ["x"]},
]


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kb") / "kb.json"
    path.write_text("\n".join(json.dumps({"ord": i, "source": "s", "url": "u", **e}) for i, e in enumerate(ENTRIES)))
    return gl.knowledge(spark, str(path))


def questions(spark):
    rng = random.Random(3)
    words = ["iron", "serum", "sugar", "Ferritin!", "glucose", "fasting", "trend", "plan", "risk", "fe", "of", "a", "an", "zzz", "hba1c", "anemia", "stores"]
    found = ["Iron", "iron serum", "ferritin level", "HBA1C", "", "glucose", "e", "tibc"]
    rows = [("n1", None, None), ("n2", "", []), ("n3", "danger plan history", [])]
    rows += [(f"q{k}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 7))), [rng.choice(found) for _ in range(rng.randint(0, 3))]) for k in range(150)]
    return rows, spark.createDataFrame(rows + rows[5:9], "question_id string, query string, findings array<string>")


def test_scores_terms_and_reasons(spark, kb):
    rows, df = questions(spark)
    as_of = F.lit("2024-06-01").cast("date")
    months = {"a": 5.1, "b": 19, "c": 66, "d": 1}
    got = {}
    for r in gl.retrieve(df, kb, as_of, k=4, min_score=0).collect():
        got[r.question_id, r.id] = (r.score, r.matched_terms, r.rationale)
        assert r.rank >= 1 and (r.content == "All about iron.") == (r.id == "a")
    want = {(qid, e["id"]): plain(q, f, e, months[e["id"]]) for qid, q, f in rows for e in ENTRIES}
    assert got and all(want[k] == v for k, v in got.items())
    scores = {(r.question_id, r.id): r.score for r in gl.all_scores(df, kb, as_of, 15).collect()}
    assert scores == {k: v[0] for k, v in want.items() if v[0] >= 15}
    # an entry reaches the score by intents alone
    assert ("n3", "b") in scores and not want["n3", "b"][1]


def test_diverse_top(spark):
    rows = [("q", 0, "x", 50), ("q", 1, "x", 40), ("q", 2, "x", 20), ("q", 3, "y", 25), ("q", 4, "z", 10), ("r", 0, "x", 20), ("r", 1, "x", 20)]
    df = spark.createDataFrame(rows, "question_id string, ord int, category string, score int")
    got = sorted((r.question_id, r.rank, r.ord) for r in gl.diverse_top(df, ["question_id"], 3).collect())
    assert got == [("q", 1, 0), ("q", 2, 1), ("q", 3, 3), ("r", 1, 0)]


def test_history_of_questions(spark):
    rows = [("s", 1, k, "user" if k % 2 == 0 else "assistant", None if k == 3 else f"t{k}") for k in range(9)] + [("s", 2, 0, "assistant", "hello")]
    got = {r.turn: r for r in ch.chat_questions(spark.createDataFrame(rows, "scope_id string, conv_id long, turn int, role string, text string")).collect()}
    assert sorted(got) == [0, 2, 4, 6, 8] and got[0].history == [] and got[8].history == ["t2", "", "t4", "t5", "t6", "t7"] and got[8].question_id == "1-8"


def test_too_many_terms_are_an_error(spark, kb, monkeypatch):
    monkeypatch.setattr(gl, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        gl.retrieve(questions(spark)[1], kb, F.lit("2024-06-01").cast("date"))
