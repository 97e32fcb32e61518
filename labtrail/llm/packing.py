"""Cost-balanced packing of whole documents into fixed-length training sequences.

A document is its token ids and one end id.  Full windows of ``capacity`` ids are
sequences of their own.  What remains of each document is dealt to groups of
about ``group_rows`` remainders; each group packs by itself: it opens as many
sequences as its ids need, takes remainders by descending estimated cost
(``linear * n + quadratic * n * n``) and gives each to the cheapest sequence
that has room for it.  If none has, the remainder is cut to fill the sequence
with most room and the rest goes on.  So a group leaves less than one sequence
of padding.

One pass tokenizes; only remainders and checksums are shuffled (``with_ids``:
all ids).  No group depends on another, so a lost executor repeats its groups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, parts_for, row_batches

CAPACITY = 2048
END_ID = 1
GROUP_ROWS = 2000
#: Full windows in one shuffled row at most, if ids are shuffled.
WINDOWS_PER_ROW = 32
#: Spellings remembered by one Python worker.
REMEMBERED = 400_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "cost double"
)

#: The vocabulary's own splitting, for lower-cased texts of the Latin-1 block.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
#: Such texts go to the tokenizer whole: separators that only Python counts as space, and what may be a special token.
_WHOLE = re.compile("[\x1c-\x1f]|<[|]").search


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin_1(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds:
    """Token ids of whole texts by a vocabulary that drops white space and marks word ends.

    Such a vocabulary never joins characters across white space, nor across the
    borders of its own splitting, so a text's ids are those of its pieces, one
    after another.  Each spelling is encoded by the tokenizer once and
    remembered.  Texts beyond Latin-1 are cut at spaces and line breaks only,
    since folding and composing characters may interact there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are shuffled as 16 bits; this vocabulary has more")
        ends = [i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn_pieces(self, new: list[str]) -> None:
        # one call for all: a piece ends where an id of a word end stands
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the vocabulary doesn't mark word ends")
        raw, at = ids.tobytes(), 0
        for piece, cut in zip(new, (4 * cuts).tolist()):
            self.pieces[piece] = raw[at:cut]
            at = cut

    def _learn_words(self, new: list[str]) -> None:
        for word, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.words[word] = np.array(e.ids, "<u4").tobytes()

    def _joined(self, split: list[list[str]], known: dict[str, bytes], learn) -> Iterator[bytes]:
        met = set(chain.from_iterable(split))
        if len(known) > REMEMBERED:
            known.clear()
        new = sorted(met - known.keys())
        if new:
            learn(new)
        return (b"".join(map(known.__getitem__, words)) for words in split)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        kinds = [2 if _WHOLE(t) else not _latin_1(t) for t in texts]
        plain = self._joined([_PIECES(t.lower()) for t, k in zip(texts, kinds) if k == 0], self.pieces, self._learn_pieces)
        other = self._joined([t.replace("\n", " ").split(" ") for t, k in zip(texts, kinds) if k == 1], self.words, self._learn_words)
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if k == 2 else next(other if k else plain)
            for t, k in zip(texts, kinds)
        ]


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


def pack(
    docs: DataFrame,
    vocab: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_rows: int = GROUP_ROWS,
    linear: float = 1.0,
    quadratic: float = 1.0 / CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it starts and how long it is, its sequence and its place there.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    text is empty, an empty text is the end id alone; a null doc_id is kept.
    Repeated rows are packed as often as they occur.  An empty table gives no
    pieces.  ``with_ids`` adds ``token_ids`` (little-endian unsigned 32-bit).
    """
    path = vocabulary(vocab)
    mid = arrow_schema("doc_id long, start long, doc_tokens long, crcs array<long>, body binary, tail binary")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        last = np.array([end_id], "<u4").tobytes()
        for batch in row_batches(batches):
            rows = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(texts)):
                raw += last
                total, whole, step = len(raw) // 4, len(raw) // (4 * capacity), WINDOWS_PER_ROW
                for at in range(0, max(whole, 1), step):
                    to = min(at + step, whole)
                    crcs = [zlib.crc32(raw[4 * capacity * k : 4 * capacity * (k + 1)]) for k in range(at, to)]
                    body = raw[4 * capacity * at : 4 * capacity * to] if with_ids else None
                    tail = raw[4 * capacity * whole :] if at + step >= whole else b""
                    rows.append((doc_id, at * capacity, total, crcs, body, np.frombuffer(tail, "<u4").astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), mid)], schema=mid)

    out_schema = PIECES + (", token_ids binary" if with_ids else "")
    out = arrow_schema(out_schema)

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        number, pieces = key[0].as_py(), []
        doc_id, start, total, crcs, body, tail = (group.column(f.name).to_pylist() for f in mid)
        price = lambda n: linear * n + quadratic * n * n
        opened = 0
        order = sorted(range(len(doc_id)), key=lambda i: (-len(tail[i]), doc_id[i] is None, doc_id[i] or 0, start[i], tail[i]))
        for i in order:
            for k, crc in enumerate(crcs[i]):
                raw = body[i][4 * capacity * k : 4 * capacity * (k + 1)] if with_ids else None
                pieces.append((doc_id[i], start[i] + k * capacity, capacity, crc, total[i], opened, 0, price(capacity), raw))
                opened += 1
        left = sum(len(t) // 2 for t in tail)
        room = np.full(parts_for(left, capacity), capacity if left else 0)
        cost = np.zeros(len(room))
        for i in order:
            ids, at = np.frombuffer(tail[i], "<u2").astype("<u4"), 0
            while at < len(ids):
                need = len(ids) - at
                fits = np.flatnonzero(room >= need)
                s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
                n = min(need, int(room[s]))
                raw = ids[at : at + n].tobytes()
                begin = start[i] + capacity * len(crcs[i]) + at
                pieces.append((doc_id[i], begin, n, zlib.crc32(raw), total[i], opened + s, capacity - int(room[s]), price(n), raw if with_ids else None))
                room[s] -= n
                cost[s] += price(n)
                at += n
        columns = list(zip(*pieces))[: len(out)] if pieces else [()] * len(out)
        columns[5] = [(number << 31) + s for s in columns[5]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    groups = parts_for(docs.count(), group_rows)
    rows = docs.select("doc_id", "text").mapInArrow(segments, "doc_id long, start long, doc_tokens long, crcs array<long>, body binary, tail binary")
    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(fill, out_schema)
