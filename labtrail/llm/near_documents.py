"""One document of each group of near duplicates stays: SimHash candidates, exact similarity of shingle sets.

Two texts are near duplicates if the sets of their word shingles have a Jaccard
similarity of ``similarity`` or more.  Whole fingerprints of such texts often
differ in more bits than a vantage-point search can prune by.  So a text also
has fingerprints of small bags of its shingles: the shingles are dealt to 2**k
bags by their hashes, of which ``BAGS`` are used, and k follows from the number
of shingles so that a bag holds about ``BAG`` of them.  Texts of similarity 0.8
have over a third of their bags in common, and so one of sixteen nearly always.
Texts whose sizes lie on both sides of a step of k have bags of both.

Candidates are texts with a bag fingerprint in common, and those that the
vantage-point search links by their whole fingerprints.  First each candidate is
compared with one text of what they have in common, the first of that bag, and
with one more, chosen by a hash, which joins most groups at little cost.  Then
all that share a bag and are still in different groups are compared: the texts
of such a bag are dealt to blocks, every two blocks meet in one task, and the
task searches from group to group over an index of its shingles.  The largest
group of a bag meets the other texts of it, not itself.  So no pair of a bag is
left out, and neither is a bag held in one task.  The links that the exact
comparison confirms are joined to groups.

Texts that are equal are one class throughout, named by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm import simhash
from labtrail.llm.common import arrow_schema, free_name, materialize, row_batches
from labtrail.operators.graph import connected

SHINGLE = 5
SIMILARITY = 0.8
BAG = 4
BAGS = 16
#: Texts, and shingles of texts, of about one block of a bag.
BLOCK = 1_000
BLOCK_SHINGLES = 1 << 20


def shingle_set(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes of a text, ascending, and its whole fingerprint."""
    hashes = list(simhash.shingle_hashes(text, size))
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return np.unique(every), simhash.majority([every])


def bag_fingerprints(own: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """A 64-bit name for each used bag of a set of shingle hashes: its level, its number and its fingerprint."""
    if not len(own):
        return np.zeros(1, np.int64)
    level = max(BAGS.bit_length() - 1, int(np.log2(len(own) / BAG)) if len(own) >= BAG else 0)
    levels = [level]
    # a text this much larger, still similar, would be on the next level
    if len(own) >= 2 * similarity * BAG * (1 << level):
        levels.append(level + 1)
    names = []
    for k in levels:
        bag = own & np.uint64((1 << k) - 1)
        used = own[bag < BAGS]
        if not len(used):
            continue
        bag = (used & np.uint64((1 << k) - 1)).astype(np.int64)
        order = np.argsort(bag, kind="stable")
        bag, used = bag[order], used[order]
        starts = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        bits = np.unpackbits(used.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(bag)))
        prints = np.packbits((2 * ones > sizes[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
        # sizes tell bags of other sizes apart whose majorities are the same
        salt = (bag[starts].astype(np.uint64) << np.uint64(32)) + (np.uint64(k) << np.uint64(24)) + sizes.astype(np.uint64)
        mixed = (prints ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        names.append(mixed.view(np.int64))
    return np.concatenate(names) if names else np.zeros(0, np.int64)


def _pairs(held: DataFrame, name: str) -> DataFrame:
    """(a, b): each class with the first one, and one chosen by a hash, of those that share ``name``."""
    firsts = held.groupBy(name).agg(
        F.min("class").alias("b1"), F.min_by("class", F.xxhash64("class", name)).alias("b2"), F.count("*").alias("n")
    ).where("n > 1")
    met = held.join(firsts, name).select(F.col("class").alias("a"), F.explode(F.array("b1", "b2")).alias("b"))
    return met.where("a != b")


def _blocks(held: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(print, i, j, own, class, label) of the bags whose texts are in several groups and weren't all compared.

    Block i of the texts outside of the bag's largest group meets the other
    such blocks (``own``), and every block j of that group.
    """
    named = held.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    each = named.groupBy("print", "label").agg(
        F.count("*").alias("n"), F.sum("size").alias("w"), F.min("class").alias("b1"), F.min(F.struct(F.xxhash64("class", "print"), "class")).alias("b2")
    )
    bags = each.groupBy("print").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("groups"), F.max(F.struct("n", "w", "label")).alias("top"),
        F.min("b1").alias("b1"), F.min("b2").alias("b2"),
    )
    # two texts, and three with two different partners, have met all others
    bags = bags.where("groups > 1 and (n > 3 or (n = 3 and b1 = b2.class))")
    parts = lambda n, w: F.greatest(F.ceil(n / block), F.ceil(w / BLOCK_SHINGLES), F.lit(1))
    bags = bags.select(
        "print", F.col("top.label").alias("top"), parts(F.col("top.n"), F.col("top.w")).alias("tops"), parts(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("others")
    )
    met = named.join(bags, "print")
    number = lambda parts: F.pmod(F.xxhash64("class", F.lit("block")), F.col(parts))
    each_of = lambda parts, at: F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), at)
    place = lambda i, j, own: F.struct(i.alias("i"), j.alias("j"), F.lit(own).alias("own"))
    mine = number("others")
    # a block meets itself wherever it meets one of the largest group
    others = F.filter(each_of("others", lambda k: place(F.least(k, mine), F.greatest(k, mine), True)), lambda x: x.i < x.j)
    others = F.concat(others, each_of("tops", lambda k: place(mine, k, False)))
    tops = each_of("others", lambda k: place(k, number("tops"), False))
    return met.select("print", "class", "label", F.explode(F.when(F.col("label") == F.col("top"), tops).otherwise(others)).alias("at")).select("print", "at.*", "class", "label")


def joining_pairs(sets: list[np.ndarray], groups: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that join all groups with a pair of similar sets between them.

    A search from set to set; the sets it has reached aren't looked at again.
    """
    sizes = np.array([len(x) for x in sets])
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    starts, ends = np.cumsum(often) - often, np.cumsum(sizes)
    members = {g: np.flatnonzero(groups == g) for g in np.unique(groups)}
    left, found = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        asked = list(members[groups[root]])
        left[asked] = False
        while asked and left.any():
            k = asked.pop()
            own = ids[ends[k] - sizes[k] : ends[k]]
            n = often[own]
            at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owners[at], minlength=len(sets))
            for j in np.flatnonzero(left & (both >= similarity * (sizes + sizes[k] - both) - 1e-9)):
                if left[j]:
                    found.append((k, j))
                    more = members[groups[j]]
                    left[more] = False
                    asked += list(more)
    return found


def groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(class, label) of the classes that are near duplicates of another; ``docs`` has ``class`` and ``text``."""
    printed_schema, set_schema = arrow_schema("class binary, fingerprint long, bags array<long>, size long"), arrow_schema("class binary, shingles binary")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            bags = [bag_fingerprints(own, similarity) for own, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for _, p in found], pa.int64()), pa.array(bags, pa.list_(pa.int64())), pa.array([len(own) for own, _ in found], pa.int64())], schema=printed_schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [shingle_set(t, size)[0].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=set_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike))

    def join_blocks(table: pa.Table) -> pa.Table:
        names, labels = table.column("class").to_pylist(), table.column("label").to_pylist()
        at = {g: k for k, g in enumerate(dict.fromkeys(labels))}
        held = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        found = joining_pairs(held, np.array([at[g] for g in labels]), similarity)
        return pa.Table.from_arrays([pa.array([names[k] for k, _ in found], pa.binary()), pa.array([names[j] for _, j in found], pa.binary())], names=["a", "b"])

    printed = docs.select("class", "text").mapInArrow(prints, "class binary, fingerprint long, bags array<long>, size long")
    # equal texts have equal prints: one row a class
    printed = printed.groupBy("class").agg(F.first("fingerprint").alias("fingerprint"), F.first("bags").alias("bags"), F.first("size").alias("size"))
    printed = materialize(printed, "bag-prints")
    points = materialize(printed.select("fingerprint").distinct(), "points")
    linked = printed.select("class", "size", "fingerprint").join(simhash.link(points), "fingerprint", "left")
    whole = linked.select("class", "size", F.coalesce("label", "fingerprint").alias("print"))
    bags = printed.select("class", "size", F.explode("bags").alias("print"))
    held = materialize(bags.union(whole).distinct(), "bag-members")
    pairs = materialize(_pairs(held, "print").distinct(), "candidate-pairs")

    def sets_of(asked: DataFrame, name: str) -> DataFrame:
        found = docs.select("class", "text").join(asked.distinct(), "class", "left_semi").mapInArrow(sets, "class binary, shingles binary")
        return materialize(found.groupBy("class").agg(F.first("shingles").alias("shingles")), name)

    compared = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")), "shingle-sets")
    left = pairs.join(compared.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    met = left.join(compared.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    labels = materialize(connected(met.mapInArrow(compare, "a binary, b binary")), "first-groups")
    rest = materialize(_blocks(held, labels, block), "blocks")
    dealt = rest.join(sets_of(rest.select("class"), "block-sets"), "class")
    joined = dealt.groupBy("print", "i", "j", "own").applyInArrow(join_blocks, "a binary, b binary")
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(joined)
    return connected(links).withColumnRenamed("node", "class")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one with the smallest doc_id.

    ``docs`` needs ``doc_id`` and ``text``; all columns stay.  A null text is
    like an empty one; texts without words are duplicates of each other.  A
    text of fewer words than a shingle is one shingle.  A null doc_id comes
    after all others, ties go to the smaller hash of the text, and of rows with
    that doc_id and that text one stays.  An empty table stays empty.
    """
    class_, key, without = free_name(docs, "class"), free_name(docs, "first"), free_name(docs, "without_id")
    named = docs.withColumn(class_, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    plain = named.select(F.col("doc_id"), F.col(class_).alias("class"), "text")
    firsts = materialize(plain.groupBy("class").agg(F.min("doc_id").alias("first")), "classes")
    labels = groups(plain, size, similarity)
    ranked = firsts.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    best = ranked.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "class")).alias("best"))
    # plain keys, so that the join's shuffle serves the last step too
    keys = [class_, key, without]
    plain_key = lambda c: [F.coalesce(c, F.lit(0)).alias(key), c.isNull().alias(without)]
    stay = best.select(F.col("best.class").alias(class_), *plain_key(F.col("best.first")))
    met = named.select("*", *plain_key(F.col("doc_id"))).join(stay, keys, "left_semi")
    return met.dropDuplicates(keys).select(*docs.columns)
