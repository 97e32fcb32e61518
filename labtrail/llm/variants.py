"""Spelling variants of words, found by PartEnum signatures of their letters.

A word's letters are a set of *bits* (letter, how often it stood before), so a
replaced letter changes two bits and an inserted or deleted one changes one.
The bits are dealt to partitions by a hash.  Two sets that differ in at most
``k`` bits agree on all but ``k`` partitions, so they share the signature of
some choice of all but ``k`` partitions (PartEnum; with ``first`` first-level
partitions, one of them differs in at most ``k // first`` bits, and choices are
made within each).  Words of equal length are joined on signatures for k = 2,
words whose lengths differ by one for k = 1, and every candidate is verified.

A signature that more than ``GROUP`` words share is split: its words meet only
if they share a string with one letter taken out as well (or the longer one
with a letter out is the shorter).  Near words do, and at most one word for each
letter and place can share such a string, so no group grows with the vocabulary.
Words of over ``CUT_LETTERS`` letters, for which that would cost the square of
their length, meet on either half instead.  Strings and signatures are hashed;
verification makes up for collisions.

Shuffles: counts of words, summed within tasks; signatures (23 a word); near
pairs.  Every step is a join or an aggregate over written tables.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, materialize, parts_for, row_batches

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
DROP_ONE_IN = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
#: (k, first-level partitions, second-level partitions of each)
SAME_LENGTH, ONE_LONGER = (2, 1, 6), (1, 1, 4)
#: Words that may share a signature before it is split.
GROUP = 64
#: Distinct words that one task counts before it hands them on.
COUNTED = 200_000
#: Words that one task signs.
SIGNED = 20_000
#: Letters up to which a word is cut at every place.
CUT_LETTERS = 200
#: Rows, and characters, of one batch handed to Spark.
BATCH, BATCH_CHARS = 20_000, 4_000_000

_MASK = (1 << 64) - 1


def spelled(doc_id: int | None, run: str) -> str:
    """The run, without one letter for about one (document, run) in 199."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROP_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``letters`` code points that occur at least ``least`` times."""
    out = arrow_schema("word string, n long")

    def flush(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, ns = list(counts.keys()), list(counts.values())
        for at in range(0, len(words), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + BATCH], pa.string()), pa.array(ns[at : at + BATCH], pa.int64())], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in row_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # bytes.lower() changes A-Z alone
                low = (text or "").encode().lower().decode()
                for run, n in Counter(RUN.findall(low)).items():
                    if len(run) >= letters:
                        counts[spelled(doc_id, run)] += n
            if len(counts) > COUNTED:
                yield from flush(counts)
                counts.clear()
        yield from flush(counts)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.char_length("word") >= letters) & (F.col("n") >= least))


def _mix(x: int) -> int:
    """A 64-bit mixing function (public, the finalizer of splitmix64)."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class PartEnum:
    """Signatures of sets of bits such that sets that differ in at most ``k`` bits share one."""

    def __init__(self, k: int, first: int, second: int):
        self.parts, within = first * second, k // first
        if second <= within:
            raise ValueError("each first-level partition needs more parts than bits may differ in it")
        self.choices = [
            tuple(f * second + p for p in chosen) for f in range(first) for chosen in combinations(range(second), second - within)
        ]

    def __call__(self, bits: list[int], salt: int) -> list[int]:
        sums = [0] * self.parts
        for b in bits:
            sums[b % self.parts] += b
        out = []
        for number, chosen in enumerate(self.choices):
            h = _mix(salt * 1009 + number)
            for p in chosen:
                h = _mix(h ^ (sums[p] & _MASK))
            out.append(_signed(h))
        return out


def bits_of(word: str) -> list[int]:
    """The letters of a word as hashed bits (letter, how often it stood before)."""
    seen: dict[str, int] = {}
    out = []
    for c in word:
        k = seen.get(c, 0)
        seen[c] = k + 1
        out.append(_mix(ord(c) << 32 | k))
    return out


_SAME, _LONGER = PartEnum(*SAME_LENGTH), PartEnum(*ONE_LONGER)


def signatures(word: str) -> list[tuple[int, int]]:
    """(signature, side): 0 meets words of its length, 1 those one letter longer, 2 those one letter shorter."""
    bits, n = bits_of(word), len(word)
    return (
        [(s, 0) for s in _SAME(bits, 2 * n)]
        + [(s, 1) for s in _LONGER(bits, 2 * n + 1)]
        + [(s, 2) for s in _LONGER(bits, 2 * n - 1)]
    )


def without_a_letter(word: str, side: int) -> set[int]:
    """Hashes of the word with each letter taken out; on side 1, of the word itself."""
    if len(word) - (side == 2) > CUT_LETTERS:
        # one letter changes at most one half; the longer word's spare letter is in one of them
        half = (len(word) - (side == 2)) // 2
        rest = len(word) - (side == 2) - half
        return {zlib.crc32(word[:half].encode()) << 1, zlib.crc32(word[len(word) - rest :].encode()) << 1 | 1}
    p, b = (1 << 61) - 1, 0x1F3D5B79
    if side == 1:
        h = 0
        for c in word:
            h = (h * b + ord(c)) % p
        return {h}
    before, out, power, after = [0], set(), 1, 0
    for c in word:
        before.append((before[-1] * b + ord(c)) % p)
    for i in range(len(word) - 1, -1, -1):
        out.add((before[i] * power + after) % p)
        after = (ord(word[i]) * power + after) % p
        power = power * b % p
    return out


def _spread(rows: DataFrame, made: Callable[[tuple], Iterable[tuple[int, int, str, int]]]) -> DataFrame:
    """The rows that ``made`` gives for each row, in bounded batches."""
    schema = "sig long, side int, word string, n long"
    out = arrow_schema(schema)

    def packed(keys: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*keys), out)], schema=out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, chars = [], 0
        for batch in row_batches(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for key in made(row):
                    keep.append(key)
                    chars += len(key[2])
                    if len(keep) >= BATCH or chars >= BATCH_CHARS:
                        yield packed(keep)
                        keep, chars = [], 0
        if keep:
            yield packed(keep)

    return rows.mapInArrow(work, schema)


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, a_n, b, b_n) of the pairs of ``words`` (word, n; distinct) one insertion, deletion or replacement apart, once each."""
    words = words.select("word", "n").repartition(parts_for(words.count(), SIGNED), "word")
    signed = materialize(_spread(words, lambda row: ((s, side, *row) for s, side in signatures(row[0]))), "word-signatures")
    large = materialize(signed.groupBy("sig").agg(F.count("*").alias("words")).where(F.col("words") > group).select("sig"), "large-signatures")
    cut = lambda row: ((_signed(_mix(row[0] & _MASK) ^ h), *row[1:]) for h in without_a_letter(row[2], row[1]))
    split = _spread(signed.join(large, "sig", "left_semi").select("sig", "side", "word", "n"), cut)
    keys = signed.join(large, "sig", "left_anti").select("sig", "side", "word", "n").unionByName(split)
    a = keys.where("side < 2").select("sig", F.col("side").alias("a_side"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keys.where("side != 1").select("sig", F.col("side").alias("b_side"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    apart = ((F.col("a_side") == 0) & (F.col("b_side") == 0) & (F.col("a") < F.col("b"))) | ((F.col("a_side") == 1) & (F.col("b_side") == 2))
    found = a.join(b, "sig").where(apart).where(F.levenshtein("a", "b", 1) == 1)
    return found.select("a", "a_n", "b", "b_n").distinct()


def roots(links: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """(word, root) of ``links`` (word, form): from each word, forms followed to the last.

    A form occurs at least ``times`` as often as its word, so counts up to
    ``most`` allow only so many steps; each round doubles the steps taken.
    """
    steps = max(1, math.ceil(math.log(max(most, 2)) / math.log(times)))
    to = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = materialize(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "word-roots")
    return to


def group_variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row per word: its form (the commonest near word, at least ``times`` as common), its root, and counts.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    text has no words; a null doc_id counts as an empty one; repeated rows
    count as often as they occur; a very long run of letters is one word.  Of
    near words equally common the first in code-point order is the form.  An
    empty table has no words.
    """
    words = materialize(count_words(docs, letters, least), "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    # strings are ordered by their UTF-8 bytes, which is code-point order
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= times * F.col("n")
    named = materialize(words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.less")).alias("form_n"),
    ), "word-forms")
    most = words.agg(F.max("n")).first()[0] or 0
    found = roots(named.where("form is not null"), most, times)
    return named.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
