"""SimHash near-duplicates: vantage-point trees partition fingerprints by Hamming distance.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes
of the text's word shingles.  Two fingerprints link if they differ in at most
``radius`` bits.

The search for links is exact.  A vantage-point tree, fitted on a bounded sample
of fingerprints, deals *all* fingerprints to shards: at each node those nearer
to its vantage point than the border go left, the others right.  By the triangle
inequality only a right one within ``radius`` of the border can link to a left
one; these overlap: they go left as well.  Each shard splits itself the same way
down to small leaves, where pairs are compared, and gives back the components of
its links, not the links, so that a group of near copies costs one row a member.
Components that share a fingerprint are then joined across shards.

Documents with one fingerprint are one point throughout.  A ball so dense that
no vantage point splits it is searched by flipping bits and looking the results
up, whose cost grows with the number of points alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, materialize, row_batches
from labtrail.operators.graph import connected

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that the vantage-point tree is fitted on, at most about so many.
SAMPLE = 50_000
#: Fingerprints in a shard, about.
SHARD = 20_000
LEAF = 400
#: Bytes of a text that are words at once.
STEP = 1 << 20

_SPACE = re.compile(rb"[\x20\t-\r]")


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``size`` words, repeats included, a step of the text at a time.

    A-Z are lower-cased; words are what stands between ASCII white space.  A
    text of fewer words is one shingle; one without words has none.
    """
    from xxhash import xxh64_intdigest

    raw, at, carried, any_shingle = (text or "").encode("utf-8", "surrogatepass").lower(), 0, [], False
    while at < len(raw):
        cut = _SPACE.search(raw, at + STEP)
        end = cut.start() if cut else len(raw)
        words = carried + raw[at:end].split()
        at = end
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
            yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
            any_shingle = True
            carried = words[len(words) - size + 1 :] if size > 1 else []
        else:
            carried = words
    if not any_shingle and carried:
        yield np.array([xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes, as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for some in hashes:
        for at in range(0, len(some), 8192):
            part = some[at : at + 8192]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(some)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    out = arrow_schema("doc_id long, fingerprint long")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [fingerprint(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, fingerprint long")


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


class Tree:
    """A vantage-point tree: points, borders and children (negative: the leaf ~child)."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, seed: int = 5):
        self.radius, self.points, self.borders, self.left, self.right, self.leaves = radius, [], [], [], [], 0
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(1, leaf))

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        split = vantage(own, self.radius, self.rng) if len(own) > leaf else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        point, border = split
        me = len(self.points)
        for column, value in ((self.points, point), (self.borders, border), (self.left, 0), (self.right, 0)):
            column.append(value)
        d = np.bitwise_count(own ^ point)
        self.left[me] = self._grow(own[d <= border + self.radius], leaf)
        self.right[me] = self._grow(own[d > border], leaf)
        return me

    def deal(self, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, fingerprints that belong or overlap into it)."""
        waiting = [(self.root, own)]
        while waiting:
            node, some = waiting.pop()
            if not len(some):
                continue
            if node < 0:
                yield ~node, some
                continue
            d = np.bitwise_count(some ^ self.points[node])
            waiting.append((self.left[node], some[d <= self.borders[node] + self.radius]))
            waiting.append((self.right[node], some[d > self.borders[node]]))


def vantage(own: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A point and a border that split ``own`` best, overlap counted; None if none takes a tenth off the larger side."""
    best = None
    some = own if len(own) <= 4000 else rng.choice(own, 4000, replace=False)
    for point in rng.choice(own, min(8, len(own)), replace=False):
        d = np.sort(np.bitwise_count(some ^ point).astype(np.int64))
        for border in {int(d[len(d) // 2]), int(d[len(d) // 2]) - 1}:
            larger = max(np.searchsorted(d, border + radius, "right"), len(d) - np.searchsorted(d, border, "right"))
            if best is None or larger < best[0]:
                best = (larger, point, border)
    return None if best[0] > 0.9 * len(some) else (best[1], best[2])


class _Groups:
    """Union of array elements, a block of pairs at a time."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.low[i], self.low[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.low, np.maximum(a, b), np.minimum(a, b))
            while True:
                next_ = self.low[self.low]
                if (next_ == self.low).all():
                    break
                self.low = next_


def groups_within(own: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints in ascending order: the number of the smallest one reachable over links."""
    groups, rng = _Groups(len(own)), np.random.default_rng(1)
    waiting = [np.arange(len(own))]
    while waiting:
        some = waiting.pop()
        split = vantage(own[some], radius, rng) if len(some) > LEAF else None
        if split is not None:
            d = np.bitwise_count(own[some] ^ split[0])
            waiting += [some[d <= split[1] + radius], some[d > split[1]]]
        elif len(some) > LEAF and sum(comb(64, k) for k in range(1, radius + 1)) < len(some) // 4:
            _by_flips(own, some, radius, groups)
        else:
            _by_pairs(own, some, radius, groups)
    return groups.low


def _by_pairs(own: np.ndarray, some: np.ndarray, radius: int, groups: _Groups) -> None:
    values = own[some]
    for at in range(0, len(some), LEAF):
        near = np.bitwise_count(values[at : at + LEAF, None] ^ values[None, at:]) <= radius
        i, j = np.nonzero(near)
        keep = i < j
        groups.join(some[at + i[keep]], some[at + j[keep]])


def _by_flips(own: np.ndarray, some: np.ndarray, radius: int, groups: _Groups) -> None:
    values = own[some]  # ascending, as own is and some keeps its order
    for bits in range(1, radius + 1):
        for places in combinations(range(64), bits):
            mask = np.uint64(sum(1 << p for p in places))
            wanted = values ^ mask
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            hit = values[at] == wanted
            if hit.any():
                groups.join(some[hit], some[at[hit]])


def link(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(fingerprint, label) of every fingerprint that links to another; the label is one of its component.

    ``points`` has distinct ``fingerprint`` values and should be stored: it is
    read three times.
    """
    n = points.count()
    share = min(1.0, sample / max(1, n))
    some = points.where(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("fingerprint")
    drawn = np.array(sorted(r.fingerprint for r in some.collect()), np.int64).view(np.uint64)
    tree = Tree(drawn, max(16, round(shard * share)), radius)
    dealt_schema, found_schema = arrow_schema("shard long, fingerprint long"), arrow_schema("fingerprint long, label long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, own in tree.deal(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), leaf)), pa.array(own.view(np.int64))], schema=dealt_schema)

    def search(table: pa.Table) -> pa.Table:
        own = np.unique(table.column("fingerprint").to_numpy().view(np.uint64))
        low = groups_within(own, radius)
        linked = np.bincount(low, minlength=len(own))[low] > 1
        return pa.Table.from_arrays([pa.array(own[linked].view(np.int64)), pa.array(own[low[linked]].view(np.int64))], schema=found_schema)

    dealt = points.select("fingerprint").mapInArrow(deal, "shard long, fingerprint long")
    found = materialize(dealt.groupBy("shard").applyInArrow(search, "fingerprint long, label long"), "shard-groups")
    # a fingerprint in several shards joins their components; a few shards hold one fingerprint at most
    own = found.groupBy("fingerprint").agg(F.min("label").alias("low"), F.collect_set("label").alias("labels"))
    across = own.where(F.size("labels") > 1).select(F.col("low").alias("a"), F.explode("labels").alias("b")).where("a != b").distinct()
    labels = connected(across)
    joined = own.select("fingerprint", "low").join(labels, F.col("low") == F.col("node"), "left")
    return joined.select("fingerprint", F.coalesce("label", "low").alias("label"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprint in hex, and the smallest doc_id reachable over links.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    text, and one without words, has fingerprint 0, which links like any other.
    Rows of the same text have the same fingerprint and so one component; a
    null doc_id is kept and never the smallest.  An empty table gives no rows.
    """
    printed = materialize(fingerprints(docs, size), "fingerprints")
    points = materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "points")
    labels = materialize(
        points.join(link(points, radius, sample, shard), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint")), "labels"
    )
    firsts = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    components = labels.join(firsts, "label").select("fingerprint", "component_id")
    return printed.join(components, "fingerprint").select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")
