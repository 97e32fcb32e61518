import zlib

import numpy as np
import pytest

from labtrail.llm import language as L

WORDS = {"aa": ["kala", "mota", "rika", "lomu"], "bb": ["strenz", "plotz", "grunkt", "wirsch"], "cc": ["øye", "håv", "blå", "småt"]}


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    langs = sorted(WORDS)
    return [(k, " ".join(rng.choice(WORDS[langs[k % 3]], 2 + k % 9)).capitalize() + ".", langs[k % 3]) for k in range(n)]


def test_subwords_by_hand():
    def h(s):
        x = 2166136261 + len(s)
        for c in s:
            x = ((x ^ (0 if c == "_" else ord(c))) * 16777619) % 2**32
        x ^= x >> 15
        return (x * 0x2C1B3C6D) % 2**32 >> 18

    # word borders are part of a subword, other words aren't
    want = ["_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_", "_ab_"]
    got = np.concatenate(list(L.subwords("Ab, c")))
    assert sorted(got) == sorted(map(h, want))
    assert sum(len(p) for p in L.subwords("1 23 .")) == 0


def test_steps_of_long_texts_give_the_same(monkeypatch):
    text = "Kala mota, strenz! " * 500
    whole = np.bincount(np.concatenate(list(L.subwords(text))), minlength=L.BUCKETS)
    monkeypatch.setattr(L, "STEP", 101)
    assert (np.bincount(np.concatenate(list(L.subwords(text))), minlength=L.BUCKETS) == whole).all()


def test_held_out_accuracy_and_labels_unused(spark):
    rows = corpus(3000)
    docs = spark.createDataFrame([(k, t, y, "s", 0.5) for k, t, y in rows], "doc_id long, text string, lang string, source string, score double")
    model = L.train(docs, sample_rows=600)
    out = L.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "rejected"]
    got = {r.doc_id: r for r in out.collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].lang_pred == y for k, y in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())
    # rows held out teach nothing: other labels there, same model
    learned = {k for k, _, _ in rows} - {k for k, _ in held}
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'aa', lang) lang")
    again = L.train(other, sample_rows=600)
    assert learned and (again.table == model.table).all() and again.temperature == model.temperature


def test_edges(spark):
    rows = [(k, t, y) for k, t, y in corpus(300)] + [(None, "kala", "aa"), (1001, None, "aa"), (1002, "", None), (1003, "12 *** !", "bb"), (1004, "Kala " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict(docs, L.train(docs)).collect()}
    for k in (1001, 1002, 1003):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[1004].lang_pred == "aa" and got[None].lang_pred == "aa"
    empty = docs.limit(0)
    assert L.predict(empty, L.train(empty)).count() == 0
    assert {r.lang_pred for r in L.predict(docs, L.train(empty)).collect()} == {"und"}


def test_scores_are_calibrated():
    # every fourth label is wrong: scores must not claim more than three in four
    rng = np.random.default_rng(3)
    rows = [(y if rng.random() > 0.25 else "bb", *L.bucket_counts(t)) for _, t, y in corpus(2000) if y != "cc"]
    model = L.fit(rows)
    scores = [model.predict(t)[1] for _, t, y in corpus(300, 9) if y == "aa"]
    assert 0.5 < np.mean(scores) < 0.9
    assert model.threshold <= L.HIGHEST_THRESHOLD


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"]])
def test_few_languages(langs):
    model = L.fit([(y, *L.bucket_counts(t)) for _, t, y in corpus(60) if y in langs])
    assert model.predict("kala mota")[0] == "aa"
