"""Exact top-k by inner product: columnar branch and bound.

Components become integers, floor(scale * x).  A block holds its vectors in
vertical layout, one contiguous row for each dimension, and for each group of
``STEP`` dimensions the length that a vector has in the dimensions after it.
A search adds up scores one group of dimensions after another.  What the
remaining dimensions can add is at most the product of the remaining lengths;
once a candidate can't reach a query's threshold (the k-th best of a few
candidates scored in full) it is dead, and when enough are, the survivors are
copied together and only they go on.

Scores are exact: sums of products of integers below 2**53 are exact in doubles;
blocks or queries with larger numbers are searched with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import materialize
from labtrail.llm.vectors import blocks, leading, meet, usable

STEP = 16
#: Vectors in a block, and queries that go through it together.
BLOCK_ROWS = 8192
TOGETHER = 16
BLOCK = "block long, dim long, ids binary, columns binary, rests binary"
_LONG = 2**63 - 1


def quantized(matrix: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these integers exactly; beyond doubles it is the largest one."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * matrix))


def vertical(scale: float):
    def pack(ids: np.ndarray, matrix: np.ndarray) -> tuple[bytes, bytes, bytes]:
        q = quantized(matrix, scale)
        return ids.astype("<i8").tobytes(), np.ascontiguousarray(q.T).astype("<f8").tobytes(), rests(q).astype("<f8").tobytes()

    return pack


def rests(q: np.ndarray) -> np.ndarray:
    """A row for each group of dimensions: the vectors' lengths in all later ones."""
    with np.errstate(over="ignore"):
        squares = np.add.reduceat(q * q, np.arange(0, q.shape[1], STEP), axis=1)
        after = squares[:, ::-1].cumsum(1)[:, ::-1] - squares
        return np.sqrt(np.maximum(after, 0)).T


def search_block(ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of the ``k`` best of the block but for the query's own row."""
    dim = len(columns)
    largest = max(np.abs(columns).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * dim
    if not largest < 2**52:
        yield from _search_large(ids, columns, query_ids, queries, k)
        return
    query_rest = rests(queries).T
    for at in range(0, len(queries), TOGETHER):
        q, r, own = queries[at : at + TOGETHER], query_rest[at : at + TOGETHER], query_ids[at : at + TOGETHER]
        alive = np.arange(len(ids))
        cols, far, scores, least = columns, rest, np.zeros((len(q), len(ids))), None
        for step, begin in enumerate(range(0, dim, STEP)):
            scores += q[:, begin : begin + STEP] @ cols[begin : begin + STEP]
            if begin + STEP >= dim:
                break
            if least is None:
                least = _threshold(scores, cols, q, own, ids, k)
            # slack for the rounding of lengths
            bound = scores + (1 + 1e-9) * r[:, step, None] * far[step][None] + 1
            hopeful = (bound >= least[:, None]).any(0)
            if hopeful.mean() < 0.6:
                alive, scores = alive[hopeful], scores[:, hopeful]
                cols, far = np.ascontiguousarray(cols[:, hopeful]), far[:, hopeful]
        for i in range(len(q)):
            others = ids[alive] != own[i]
            names, found = ids[alive][others], scores[i][others]
            best = leading(found, names, k)
            yield int(own[i]), names[best], found[best].astype(np.int64)


def _threshold(scores: np.ndarray, columns: np.ndarray, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A score that k candidates of each query reach: those best so far, scored in full."""
    if scores.shape[1] <= 2 * k:
        return np.full(len(q), -np.inf)
    first = np.argpartition(scores, scores.shape[1] - 2 * k, axis=1)[:, -2 * k :]
    full = np.einsum("qd,dqc->qc", q, columns[:, first])
    full[ids[first] == own[:, None]] = -np.inf
    return np.partition(full, full.shape[1] - k, axis=1)[:, full.shape[1] - k]


def _search_large(ids: np.ndarray, columns: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    exact = [[int(x) for x in row] for row in columns.T]
    for own, query in zip(query_ids, queries):
        q = [int(x) for x in query]
        scored = sorted((-sum(a * b for a, b in zip(q, row)), int(i)) for row, i in zip(exact, ids) if i != own)[:k]
        yield int(own), np.array([i for _, i in scored], np.int64), np.array([max(-_LONG - 1, min(_LONG, -s)) for s, _ in scored], np.int64)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest integer inner products of each query.

    ``vectors`` needs ``vec_id`` and ``embedding``; queries are the rows whose
    id is divisible by ``every``, candidates all rows with another id.  Ties go
    to the smaller id.  Rows without an id, and vectors that are null, empty or
    hold null or non-finite components, take no part; vectors of another length
    than the query's are no candidates.  A row that is repeated as it is counts
    once; several vectors under one id are candidates each for itself, and as
    queries share one ranking.  Scores beyond 64 bits are the nearest 64-bit
    number.  An empty table gives no rows.
    """
    rows = usable(vectors, nonzero=False)
    base = materialize(blocks(rows, block_rows, vertical(scale), BLOCK), "columns")

    def search(row: dict, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids = np.frombuffer(row["ids"], "<i8")
        columns = np.frombuffer(row["columns"], "<f8").reshape(row["dim"], len(ids))
        rest = np.frombuffer(row["rests"], "<f8").reshape(-1, len(ids))
        return search_block(ids, columns, rest, query_ids, quantized(queries, scale), k)

    return meet(base, rows.where(F.col("vec_id") % every == 0), search, "long", k)
