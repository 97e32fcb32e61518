import corpus_pipeline as C

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    passage = "\n".join(f"a shared line number {k} of the notice" for k in range(9))
    rows = []
    for k in range(240):
        own = "\n".join(" ".join(f"tok{(k * 31 + j * 7 + i) % 977}" for i in range(12)) for j in range(6))
        lang = "xx" if k % 2 else "yy"
        own = own.replace("tok", "stra") if k % 2 else own.replace("tok", "melo")
        rows.append([k, own + (f"\n{passage}" if k % 8 == 0 else ""), lang, f"src{k % 3}"])
    rows.append([300, None, "xx", "src0"])
    rows.append([301, "*** 123", None, None])
    rows.append([302, rows[5][1], None, "src1"])  # an exact copy
    near = rows[7][1].split(" ")
    near[30] = "straother"
    rows.append([303, " ".join(near), "xx", "src1"])
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_each_stage_on_its_input(spark):
    docs = spark.createDataFrame(corpus(), DOCUMENTS)
    texts = {r[0]: r[1] for r in corpus()}
    kept = C.STAGES[0][1](spark, docs, "")
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == set(texts) - {300, 301} and got[302].lang == "xx"

    once = {r.doc_id: r for r in C.STAGES[1][1](spark, docs, "").collect()}
    assert sum("a shared line number 4" in (r.text or "") for r in once.values()) == 1
    assert once[1].text == texts[1] and all(r.n_chars == len(r.text) for r in once.values() if r.text is not None)

    alone = {r.doc_id for r in C.STAGES[2][1](spark, docs, "").collect()}
    assert 302 not in alone and 303 not in alone and {5, 7, 300} <= alone

    mixed = C.STAGES[3][1](spark, docs, "")
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= set(texts.values())


def test_stages_follow_each_other(spark):
    docs = spark.createDataFrame(corpus(), DOCUMENTS)
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, ""), "test-stage")
        if name == "near dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
    kept = set(texts)
    # of the near copy only the passage with the changed word is left, as the rest stands elsewhere
    assert not {300, 301, 302} & kept and len(kept) == 241 and len(texts[303]) < len(texts[7])
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} <= kept and all(len(r.token_ids) == 4 * r.length for r in pieces)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, ""), "test-stage")
    assert docs.count() == 0
