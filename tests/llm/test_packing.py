import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from labtrail.llm import packing

SCHEMA = "doc_id long, text string, pack_group string, start string"
TEXTS = [
    None, "", "a", "Hello, World's END", "<|endoftext|> x <|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ é é ﬁ", "x\x1cy\x85z\xa0w", "naïve ÜBER 12½ ª²",
    "deux mots\n\nencore " * 900, "w" * 5000, "B a " * 3000, "B a " * 3000,
]


@pytest.mark.parametrize("with_ids", [False, True])
def test_pieces_cover_every_id_once(spark, with_ids):
    rows = [(i, t, "g", "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "again", "g", "s")]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), group_rows=5, with_ids=with_ids).collect()
    reference = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append(np.array([*reference.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
        if with_ids:
            assert zlib.crc32(r.token_ids) == r.ids_crc32 and len(r.token_ids) == 4 * r.length
    for doc_id, docs in want.items():
        for ids in docs:
            at = 0
            for r in sorted(pieces[doc_id, len(ids)], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    # a group leaves less than one sequence of padding
    assert sum(2048 - sum(n for _, n in p) for p in filled.values()) < 2048 * packing.parts_for(len(rows), 5)


def test_costs_are_balanced(spark):
    docs = spark.createDataFrame([(i, "ab " * (1 + 37 * i % 900)) for i in range(400)], "doc_id long, text string")
    by = defaultdict(float)
    for r in packing.pack(docs).collect():
        by[r.sequence_id] += r.cost
    assert max(by.values()) <= 1.5 * np.mean(list(by.values()))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
