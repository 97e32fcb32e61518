"""Compute expensive text functions once per distinct value.

Millions of rows share a few thousand spellings.  The distinct spellings are
collected with one partially aggregated pass over pruned columns, the text
functions run on those only, and the answers are joined back.

The dictionary is written to the shared folder before it is joined.  Spark so
knows its size when it plans the join: it broadcasts a dictionary below
``spark.sql.autoBroadcastJoinThreshold``, and joins a larger one by a shuffle,
whose hot spellings AQE splits.  Nothing stays cached.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.session import materialize


def with_derived(df: DataFrame, plan: dict[str, dict[str, Column]], spelled_in: DataFrame | None = None) -> DataFrame:
    """Add columns computed once per distinct value of their source columns.

    ``plan`` maps a source column to its answers, each an expression over
    column ``_key`` (the source value) and over the answers before it; a column
    of the same name is replaced.  The combinations of sources that occur are
    collected in one pass over ``df`` and joined to it once: a ``df`` that is
    expensive to compute should be materialized first, since both compute it, or
    ``spelled_in`` be given, a table that has its combinations and costs less.
    """
    keys = {source: f"_key{k}" for k, source in enumerate(plan)}
    met = (spelled_in or df).select(*[F.col(s).alias(k) for s, k in keys.items()]).distinct()
    met = materialize(met, "spellings") if len(plan) > 1 else met
    found = met
    for source, answers in plan.items():
        part = met.select(F.col(keys[source]).alias("_key")).distinct()
        for name, answer in answers.items():
            part = part.withColumn(name, answer)
        found = found.join(part, F.col(keys[source]).eqNullSafe(F.col("_key")), "left").drop("_key") if len(plan) > 1 else part.withColumnRenamed("_key", keys[source])
    found = materialize(found.withColumnsRenamed({k: f"_of{k}" for k in keys.values()}), "dictionary")
    made = [n for answers in plan.values() for n in answers]
    kept = [c for c in df.columns if c not in made]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys.values()])
    return df.select(*kept, *[F.col(s).alias(k) for s, k in keys.items()]).join(found, same, "left").select(*kept, *made)
