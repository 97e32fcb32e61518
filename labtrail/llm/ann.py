"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per shard.

A shard has a bounded number of vectors.  Its graph has levels: every vector is
on level 0, and one in ``LINKS`` of each level is on the next.  Vectors are taken
in random order; each is linked, on each of its levels, to diverse ones among
the nearest taken before it, and they link back, keeping diverse links up to a
limit.  Candidates for links come from blockwise matrix products instead of
searches of the unfinished graph, which a shard is small enough for.

The graph is stored as flat arrays in one row of a table: for each level, a row
of neighbour numbers for each of its vectors.  A search descends greedily to
level 0, keeps a list of the ``breadth`` nearest there, scores what it found with
the original vectors in doubles, and the shards' results are merged.

Equal vectors are one node, which stands for all their ids; so no group of
copies can fill the neighbour lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import materialize
from labtrail.llm.vectors import blocks, leading, meet, usable

LINKS = 16
#: Nearest earlier vectors that links are chosen from.
CANDIDATES = 64
#: Length of the list kept while level 0 is searched.
BREADTH = 160
SHARD_ROWS = 8192
GRAPH = "block long, dim long, ids binary, vectors binary, graph binary"


def _diverse(unit: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of ``near`` (nearest first): those nearer to the vector than to any chosen one, then the nearest others."""
    if len(near) <= most:
        return near
    between = unit[near] @ unit[near].T
    open_, chosen = np.ones(len(near), bool), []
    while len(chosen) < most:
        at = int(np.argmax(open_))
        if not open_[at]:
            break
        chosen.append(at)
        open_ &= between[at] <= sims
        open_[at] = False
    if len(chosen) < most:
        rest = np.setdiff1d(np.arange(len(near)), chosen, assume_unique=True)
        chosen += rest[: most - len(chosen)].tolist()
    return near[chosen]


def _level(unit: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Neighbour numbers (places in the level, -1: none) of the level's vectors, in the order they were taken."""
    n, own = len(members), unit[members]
    links: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    back: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 512):
        rows = min(512, n - at)
        sims = own[at : at + rows] @ own[: at + rows].T
        for i in range(rows):
            before = sims[i, : at + i]
            if not len(before):
                continue
            if len(before) > CANDIDATES:
                near = np.argpartition(before, len(before) - CANDIDATES)[len(before) - CANDIDATES :]
            else:
                near = np.arange(len(before))
            near = near[np.argsort(-before[near], kind="stable")]
            links[at + i] = _diverse(own, near, before[near], LINKS)
            for j in links[at + i]:
                back[j].append(at + i)
    out = np.full((n, most), -1, np.int32)
    for i in range(n):
        near = np.concatenate([links[i], np.array(back[i], np.int64)]).astype(np.int64)
        if len(near) > most:
            sims = own[near] @ own[i]
            order = np.argsort(-sims, kind="stable")
            near = _diverse(own, near[order], sims[order], most)
        out[i, : len(near)] = near
    return out


def build(matrix: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from 0 up: the places of its vectors in ``matrix``, and their neighbours as places in ``matrix``."""
    unit = _unit(matrix)
    rng = np.random.default_rng(seed)
    taken = rng.permutation(len(matrix))
    height = np.floor(-np.log(1 - rng.random(len(matrix))) / np.log(LINKS)).astype(int)
    levels = []
    for level in range(height.max(initial=0) + 1):
        members = taken[height[taken] >= level]
        near = _level(unit, members, 2 * LINKS if level == 0 else LINKS)
        levels.append((members, np.where(near >= 0, members[near], -1).astype(np.int32)))
    return levels


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small components leave the range of doubles
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def flat(levels: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Number of levels; for each, vectors and width; then members and neighbours."""
    head = [len(levels), *[x for members, near in levels for x in (len(members), near.shape[1])]]
    parts = [np.array(head, "<i4"), *[part.astype("<i4").ravel() for level in levels for part in level]]
    return np.concatenate(parts).tobytes()


def unflat(raw: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(raw, "<i4")
    at, levels = 1 + 2 * int(data[0]), []
    for level in range(int(data[0])):
        n, width = int(data[1 + 2 * level]), int(data[2 + 2 * level])
        levels.append((data[at : at + n], data[at + n : at + n + n * width].reshape(n, width)))
        at += n * (1 + width)
    return levels


class Graph:
    """A shard's graph, ready to be searched."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], matrix: np.ndarray):
        self.unit, self.levels = _unit(matrix), levels
        self.near: list[np.ndarray | dict[int, np.ndarray]] = []
        for k, (members, near) in enumerate(levels):
            if k:
                self.near.append(dict(zip(members.tolist(), near)))
            else:
                rows = np.full((len(matrix), near.shape[1]), -1, np.int32)
                rows[members] = near
                self.near.append(rows)

    def search(self, query: np.ndarray, breadth: int) -> np.ndarray:
        """Places of about the ``breadth`` nearest vectors."""
        at = int(self.levels[-1][0][0])
        best = float(self.unit[at] @ query)
        for level in range(len(self.levels) - 1, 0, -1):
            while True:
                near = self.near[level][at]
                near = near[near >= 0]
                if not len(near):
                    break
                sims = self.unit[near] @ query
                k = int(np.argmax(sims))
                if sims[k] <= best:
                    break
                at, best = int(near[k]), float(sims[k])
        seen = np.zeros(len(self.unit), bool)
        seen[at] = True
        ahead, kept = [(-best, at)], [(best, at)]
        rows = self.near[0]
        while ahead:
            sim, node = heappop(ahead)
            if -sim < kept[0][0] and len(kept) >= breadth:
                break
            near = rows[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            sims = self.unit[near] @ query
            if len(kept) >= breadth:
                good = sims > kept[0][0]
                near, sims = near[good], sims[good]
            for s, v in zip(sims.tolist(), near.tolist()):
                if len(kept) < breadth:
                    heappush(kept, (s, v))
                elif s > kept[0][0]:
                    heapreplace(kept, (s, v))
                else:
                    continue
                heappush(ahead, (-s, v))
        return np.array([v for _, v in kept])


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in doubles; vectors whose squares leave the range of doubles are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (rows @ query) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))
        odd = ~np.isfinite(out)
        if odd.any() or not 1e-280 < (query * query).sum() < 1e280:
            a, b = rows / np.abs(rows).max(1, keepdims=True), query / np.abs(query).max()
            out = (a @ b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b))
    return out


def _pack(ids: np.ndarray, matrix: np.ndarray) -> tuple[bytes, bytes, bytes]:
    # distinct vectors are the nodes; a node's ids follow each other
    distinct, node = np.unique(matrix, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    names = np.stack([node.ravel()[order], ids[order]]).astype("<i8")
    return names.tobytes(), distinct.astype("<f8").tobytes(), flat(build(distinct))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index of all usable vectors: one row per shard, with its ids, vectors and graph."""
    return materialize(blocks(usable(vectors, nonzero=True), shard_rows, _pack, GRAPH), "graphs")


def search_index(graphs: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest found for each of ``queries`` (vec_id, embedding), but for rows of its own id."""
    opened: dict[tuple, tuple] = {}

    def search(row: dict, query_ids: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        shard = (row["block"], row["dim"])
        if shard not in opened:
            opened.clear()  # one shard at a time
            matrix = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
            opened[shard] = (np.frombuffer(row["ids"], "<i8").reshape(2, -1), matrix, Graph(unflat(row["graph"]), matrix))
        (nodes, ids), matrix, graph = opened[shard]
        unit = _unit(asked)
        for i in range(len(asked)):
            found = graph.search(unit[i], max(breadth, k + 1))
            scores = cosine(asked[i], matrix[found])
            # all nodes that tie with the last one needed; then their ids
            top = np.flatnonzero(scores >= scores[leading(scores, found, k + 1)[-1]])
            begins, ends = np.searchsorted(nodes, found[top], "left"), np.searchsorted(nodes, found[top], "right")
            names = np.concatenate([ids[b : min(e, b + k + 1)] for b, e in zip(begins, ends)])
            named = np.repeat(scores[top], [min(e - b, k + 1) for b, e in zip(begins, ends)])
            others = names != query_ids[i]
            best = leading(named[others], names[others], k)
            yield int(query_ids[i]), names[others][best], named[others][best]

    return meet(graphs, usable(queries, nonzero=True), search, "double", k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each query, nearest first, ties to the smaller id.

    ``vectors`` needs ``vec_id`` and ``embedding``; queries are the rows whose
    id is divisible by ``every``, candidates all rows with another id.  The
    score is the cosine in doubles.  Rows without an id, and vectors that are
    null, empty, all zero or hold null or non-finite components, take no part;
    vectors of another length than the query's are no candidates.  A row that
    is repeated as it is counts once; several vectors under one id share one
    ranking as queries.  An empty table gives no rows.
    """
    return search_index(index(vectors, shard_rows), vectors.where(F.col("vec_id") % every == 0), k, breadth)
