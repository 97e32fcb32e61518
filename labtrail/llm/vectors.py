"""Blocks of vectors: how searches of a query set against all rows are laid out on the cluster.

All vectors are dealt to blocks of bounded size by a hash of their id, and the
queries to query blocks.  Every query block meets every vector block once, as
one row: the pairs that are formed are of blocks, never of rows.  Each meeting
gives the best of that block for each query, and a ranking by query merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, materialize, parts_for

BLOCK = "block long, dim long, ids binary, vectors binary"
QUERY_ROWS = 1024


def usable(table: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector of finite numbers that isn't empty (or all zero)."""
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def blocks(rows: DataFrame, each: int, pack: Callable[[np.ndarray, np.ndarray], tuple[bytes, bytes, bytes]], schema: str, count: int | None = None) -> DataFrame:
    """About ``each`` vectors to a row: ``pack`` gets the ids in ascending order and the vectors, and gives the binary columns.

    Rows of the same id and the same vector are one.  Vectors of different
    lengths go to different rows.
    """
    out = arrow_schema(schema)
    n = parts_for(rows.count() if count is None else count, each)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        v = group.column("v").combine_chunks()
        dim = key[1].as_py()
        matrix = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.lexsort((*matrix.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, matrix = ids[order], matrix[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (matrix[1:] == matrix[:-1]).all(1)
        made = pack(ids[~again], np.ascontiguousarray(matrix[~again]))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip([key[0].as_py(), dim, *made], out)], schema=out)

    keyed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), F.size("v").cast("long").alias("dim"), "vec_id", "v")
    return keyed.groupBy("block", "dim").applyInArrow(build, schema)


def plain(ids: np.ndarray, matrix: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype("<i8").tobytes(), matrix.astype("<f8").tobytes()


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)


def meet(
    base: DataFrame,
    queries: DataFrame,
    search: Callable[[dict, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    score: str,
    k: int,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest scores of each query, ties to smaller ids.

    ``base`` is a stored table of blocks; ``search`` gets one of its rows and
    the queries' ids and vectors, and yields for each query the ids and scores
    that are best in the block.  Blocks are few and large; where there are fewer
    than the cluster has cores, each goes to several tasks, which share the
    query blocks.
    """
    spark = base.sparkSession
    asked = materialize(blocks(queries, query_rows, plain, BLOCK), "query-blocks")
    numbers = base.select("block").distinct()
    many = base.count()
    copies = max(1, min(16, 2 * spark.sparkContext.defaultParallelism // max(1, many)))
    slot = F.pmod(F.col("block"), F.lit(copies))
    # the numbers of the blocks are 0, 1, ...; a query block is sent to each
    top = (numbers.agg(F.max("block").alias("b")).first().b or 0) if many else -1
    if top < 0:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    sent = asked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top).cast("long"))).alias("block"), slot.alias("slot"), "dim",
        F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"),
    )
    held = base.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    # never a broadcast: sent is as large as the queries times the blocks, but Spark takes it for the queries
    met = sent.join(held.hint("merge"), ["block", "slot", "dim"])
    out = arrow_schema(f"query_id long, vec_id long, score {score}")
    names = met.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r].as_py() for c, name in enumerate(names)}
                ids, vectors = unpack(row.pop("query_ids"), row.pop("query_vectors"), row["dim"])
                found = list(search(row, ids, vectors))
                if found:
                    owner = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(x) for _, x, _ in found])
                    arrays = [owner, np.concatenate([x for _, x, _ in found]), np.concatenate([s for _, _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, out)], schema=out)

    best = met.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
