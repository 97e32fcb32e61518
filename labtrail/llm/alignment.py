"""Alignment of two tokenizers on the same texts, and links of their tokens.

Both token lists of a text spell the same bytes.  The cumulative ends of each
list's tokens go into a dictionary from end to index, which is an array with a
slot for every byte; the ends that both dictionaries hold, in order, cut both
lists into groups.  Within the slices, every stretch between two neighbouring
ends of either list is one link, between the two tokens it lies in; all slices
are expanded at once.

One pass encodes whole texts and writes, for each document, its counts, digest
and link counts.  Then counts of id pairs are summed over the corpus, and each
document's pairs meet them: the commonest pairs (at most ``FREQUENT``, 24 bytes
each) as a broadcast table, all others by a shuffle join in which no pair has
more than one row in ``FREQUENT``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, materialize, row_batches
from labtrail.llm.packing import vocabulary

ALIGNED = (
    "doc_id long, content long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links array<struct<pair:long,times:int>>"
)
#: Pairs in the broadcast table at most; a pair is in it that has more than one row of all in so many.
FREQUENT = 1 << 16

#: Characters that all libraries class alike; texts with others go to the vocabulary's own library.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00a0-\u024f]").search


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two lists of cumulative ends, which share the last.

    The groups as the ends of their slices in either list, and the links as
    indexes into either list, in order.
    """
    size = int(a_ends[-1]) + 1
    of_a, of_b = np.zeros(size, np.int32), np.zeros(size, np.int32)
    of_a[a_ends] = np.arange(1, len(a_ends) + 1)
    of_b[b_ends] = np.arange(1, len(b_ends) + 1)
    common = np.flatnonzero((of_a > 0) & (of_b > 0))
    # a stretch that ends within a slice, or with it, lies in the tokens that end there or next
    stretches = np.flatnonzero((of_a > 0) | (of_b > 0))
    in_a, in_b = (np.cumsum(of > 0)[stretches - 1] for of in (of_a, of_b))
    return of_a[common], of_b[common], in_a, in_b


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and the bytes of their tokens.  One per worker process."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        entries = {i: bytes(letters[c] for c in entry) for entry, i in model["vocab"].items() if all(c in letters for c in entry)}
        # a second library reads the same entries as ranks, if their ids are in the order of the merges
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = {entries[i]: i for i in range(256 + len(merged))} if [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))) else None
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([*map(len, table)], np.int64) for table in (self.a_bytes, self.b_bytes))
        # ids as they are written: within a group, at the end of a's and at the end of b's part; digits by place
        self.block = max(len(self.a_bytes), len(self.b_bytes))
        told = [f"{i}{mark}".encode() for mark in ",|;" for i in range(self.block)]
        self.width = np.array([*map(len, told)], np.int8)
        self.told = np.array(told).view(np.uint8).reshape(len(told), -1)

    def a_ids(self, text: str) -> np.ndarray:
        if self.fast is None or _OTHER(text):
            return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(" " + text).astype(np.int64)

    def digest(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        """Hex digest of ``a1,a2|b1;a3|b2,b3``."""
        marks = []
        for ids, to, mark in ((a, to_a, 1), (b, to_b, 2)):
            shown = ids.copy()
            shown[to - 1] += mark * self.block
            marks.append(shown)
        # a's part of each group, then b's: the place of a token is its index and the other list's before it
        place_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], to_b[:-1]]), np.diff(to_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = marks
        digits = self.told[order]
        written = digits[np.arange(digits.shape[1]) < self.width[order][:, None]]
        return hashlib.sha256(written[:-1].tobytes()).hexdigest()

    def __call__(self, texts: list[str]) -> list[tuple]:
        """For each text: tokens a, tokens b, groups, links, digest, linked id pairs and how often each is linked."""
        return [self._one(t, b) for t, b in zip(texts, self.b.encode(texts, num_threads=1))]

    def _one(self, text: str, b: list[int]) -> tuple:
        nothing = 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        raw = (" " + text).encode()
        # byte-level entries spell what they are given, except where the library changes odd characters
        if not text or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return nothing
        a, b = self.a_ids(text), np.array(b, np.int64)
        a_ends = np.cumsum(self.a_sizes[a])
        if a_ends[-1] != len(raw) or _OTHER(text) and b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return nothing
        to_a, to_b, in_a, in_b = align(a_ends, np.cumsum(self.b_sizes[b]))
        pairs, times = np.unique(b[in_b] << 32 | a[in_a], return_counts=True)
        return len(a), len(b), len(to_a), len(in_a), self.digest(a, b, to_a, to_b), pairs, times


@cache
def open_pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def encode_both(docs: DataFrame, a_vocab: str, b_vocab: str) -> DataFrame:
    """``ALIGNED`` rows of ``docs``: counts, digest and distinct linked id pairs (b id * 2**32 + a id) of each document."""
    a_path, b_path, out = vocabulary(a_vocab), vocabulary(b_vocab), arrow_schema(ALIGNED)
    pairs_type = pa.struct([("pair", pa.int64()), ("times", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = open_pair(a_path, b_path)
        for batch in row_batches(batches, 128):
            found = both([t or "" for t in batch.column(2).to_pylist()])
            columns = [pa.array(c, f.type) for c, f in zip(list(zip(*found))[:5], list(out)[2:7])]
            offsets = np.cumsum([0, *(len(r[5]) for r in found)], dtype=np.int32)
            pairs, times = (np.concatenate([r[k] for r in found]) for k in (5, 6))
            links = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times.astype(np.int32))], fields=list(pairs_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.ListArray.from_arrays(pa.array(offsets), links)], names=out.names)

    return docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(work, ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best, rows) over the corpus: its links, whether no pair of its b id has more, and its rows in ``links`` (pair, times)."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("rows")).withColumn("b", F.shiftright("pair", 32))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "rows")


def align_tokens(docs: DataFrame, a_vocab: str = "byte_bpe_50k.json", b_vocab: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of ``docs``: tokens, groups and links of both tokenizers, and how common its links are in all ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A text
    is encoded behind one space (the second vocabulary adds it by itself).  A
    null or empty text, and one whose bytes the tokens don't spell, has no
    tokens: zeros and an empty digest.  ``n_best`` counts the links whose id
    pair has the most links of all pairs of its b id, ties included;
    ``count_sum`` sums the corpus counts of the document's links.  Rows that
    repeat one doc_id and text give repeated rows and count each; an empty
    table gives none.
    """
    base = materialize(encode_both(docs, a_vocab, b_vocab), "aligned-tokens")
    key = ["doc_id", "content"]
    links = base.select(*key, F.inline("links"))
    counts = materialize(pair_counts(links), "pair-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    frequent = counts.where(F.col("rows") * FREQUENT > total).select("pair", "n", "best")
    rest = counts.where(F.col("rows") * FREQUENT <= total).select("pair", "n", "best")
    known = links.join(F.broadcast(frequent), "pair", "left")
    values = lambda n, best: (F.sum(F.when(best, F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * n).alias("count_sum"))
    hot = known.where("n is not null").groupBy(key).agg(*values(F.col("n"), F.col("best")))
    cold = known.where("n is null").select(*key, "pair", "times").join(rest, "pair").groupBy(key).agg(*values(F.col("n"), F.col("best")))
    digits = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = base.groupBy(key).agg(F.any_value(F.struct(*digits)).alias("own"), F.count("*").alias("copies"))
    empty = F.lit(None).cast(own.schema["own"].dataType)
    parts = [own.select(*key, "own", "copies", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))]
    parts += [p.select(*key, empty.alias("own"), F.lit(0).cast("long").alias("copies"), "n_best", "count_sum") for p in (hot, cold)]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(key).agg(
        F.max("own").alias("own"), F.sum("copies").alias("copies"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    # the sums are over all copies of a row
    each = lambda c: F.expr(f"{c} div copies")
    return met.select(
        "doc_id", *[F.col(f"own.{c}") for c in digits[:4]], each("n_best").alias("n_best"), each("count_sum").alias("count_sum"),
        "own.groups_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
