"""Record normalization and duplicate resolution.

Rows are shuffled once, by scope and cluster, and everything else is done in
sorted groups that spill when they are large: a row is written once however many
facts of its group it waits for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions import names as nm
from labtrail.functions import values as va
from labtrail.functions.basic import blank_to_null, placed, strip
from labtrail.functions.status import normalize_status
from labtrail.operators.dictionary import with_derived

SCOPE = "scope_id"
ORDER = "row_ord"


def raw_name(df: DataFrame) -> Column:
    """Original test name, else test name, trimmed; empty text when both lack."""
    options = [F.col(c) for c in ("Original_Test_Name", "Test_Name") if c in df.columns]
    return F.coalesce(
        strip(F.coalesce(*[F.nullif(o, F.lit("")) for o in options])), F.lit("")
    )


def _own_aliases(df: DataFrame) -> Column:
    if "Aliases" not in df.columns:
        return F.array().cast("array<string>")
    return F.coalesce(F.col("Aliases"), F.array().cast("array<string>"))


def name_facts() -> dict[str, Column]:
    """Everything derived from a raw test name (read from column ``_key``)."""
    raw, name = F.col("_key"), F.col("Test_Name")
    spelling = F.when(raw == "", F.lit(nm.UNKNOWN_TEST)).otherwise(raw)
    return {
        "Test_Name": nm.normalize_test_name(raw),
        "_cluster": nm.cluster_key(name),
        "_hint": nm.category_hint(name),
        "_name_score": nm.name_score(spelling),
    }


def normalize_records(df: DataFrame, spelled_in: DataFrame | None = None) -> DataFrame:
    """Canonical name, category, status and aliases on every record.
    ``spelled_in``: rows with the same names, categories and statuses, read for them in place of ``df``.

    Adds the helper columns ``_cluster``, ``_hint`` and ``_name_score`` that
    :func:`deduplicate` needs; :func:`resolve_records` drops them again.
    """
    for c in ("Test_Category", "Status"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))

    if spelled_in is not None:
        spelled_in = spelled_in.select("Test_Category", "Status", raw_name(spelled_in).alias("_raw"))
    tidy = with_derived(
        df.withColumn("_raw", raw_name(df)),
        {
            "_raw": {**name_facts(), "_names": va.unique_strings(F.array(F.col("_key"), F.col("Test_Name")))},
            "Test_Category": {"_category": nm.canonical_category(F.col("_key"))},
            "Status": {"_known_status": normalize_status(F.col("_key"))},
        },
        spelled_in,
    )
    aliases = va.unique_strings(F.concat(_own_aliases(df), "_names")) if "Aliases" in df.columns else F.col("_names")
    return (
        tidy.withColumn("Aliases", aliases)
        .withColumn("Original_Test_Name", F.nullif(F.col("_raw"), F.lit("")))
        .withColumn("Test_Category", F.col("_category"))
        .withColumn("Status", F.col("_known_status"))
        .drop("_raw", "_category", "_known_status", "_names")
    )


HELPERS = ["_cluster", "_hint", "_name_score"]


def with_reading_place(df: DataFrame, keys: list[str], order: str = ORDER) -> DataFrame:
    """Adds ``_place`` to every row, its place among those of its (keys,
    Test_Date text): numeric rows first, then the most complete, the longest
    range, the longest unit, the earliest row."""
    date_key = F.coalesce(blank_to_null(F.col("Test_Date")), F.lit("N/A"))
    complete = va.completeness(F.col("Result"), F.col("Reference_Range"), F.col("Unit"), F.col("Status"))
    rank = {
        "_numeric": va.parse_numeric(F.col("Result")).isNotNull(), "_complete": complete,
        "_range": F.coalesce(F.length("Reference_Range"), F.lit(0)), "_unit": F.coalesce(F.length("Unit"), F.lit(0)),
    }
    best = Window.partitionBy(*keys, "_date_key").orderBy(*[F.desc(c) for c in rank], order)
    return df.withColumns({"_date_key": date_key, **rank}).withColumn("_place", F.row_number().over(best)).drop("_date_key", *rank)


def merge_readings(
    df: DataFrame, keys: list[str], carry: list[str] | None = None, order: str = ORDER
) -> DataFrame:
    """One row per (keys, Test_Date text), the first by :func:`with_reading_place`.

    A rank, not an aggregate of whole rows: columns that nobody reads are not
    shuffled, and map tasks send one row of a group each."""
    carry = carry or [c for c in df.columns if c not in keys]
    return with_reading_place(df, keys, order).where("_place = 1").select(*keys, *carry)


def with_vote(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a group's most trusted, then most frequent, then first-seen category; null where all are "Other".

    There are fourteen canonical categories, so the vote is a fixed number of
    conditional counts, then a minimum, over the same sorted groups.
    """
    group, cat = Window.partitionBy(*keys), F.col("Test_Category")
    known = {c: p for c, p in fv.CATEGORY_PRIORITY.items() if c != "Other"}
    counted = df.withColumns({f"_n{i}": F.count_if(cat == c).over(group) for i, c in enumerate(known)})
    ballot = F.lit(None).cast("struct<p:int,n:bigint>")
    for i, (c, p) in enumerate(known.items()):
        ballot = F.when(cat == c, F.struct(F.lit(-p).alias("p"), (-F.col(f"_n{i}")).alias("n"))).otherwise(ballot)
    voted = counted.withColumn("_ballot", ballot).drop(*[f"_n{i}" for i in range(len(known))])
    vote = F.min(F.when(F.col("_ballot").isNotNull(), F.struct("_ballot.p", "_ballot.n", F.col(ORDER).alias("o"), cat.alias("cat"))))
    return voted.withColumn(name, vote.over(group)["cat"]).drop("_ballot")


def best_spelling(value: Column, score: Column, order: Column) -> Column:
    """Aggregate: value of the highest scored spelling, first seen on ties."""
    return F.min_by(value, F.struct((-score).alias("s"), order.alias("o")))


def with_cluster_facts(normalized: DataFrame, keys: list[str]) -> DataFrame:
    """Adds name, category and aliases of its cluster to every row: ``_canonical``,
    ``_resolved`` and ``_seen``, of which :func:`all_aliases` makes the aliases.

    One sort of each group serves all three.  Groups are sorted, not held, and
    of equal lists of aliases the first is collected only.
    """
    group = Window.partitionBy(*keys)
    first = F.row_number().over(Window.partitionBy(*keys, "Aliases").orderBy(ORDER)) == 1
    rows = with_vote(normalized.withColumn("_new", first), keys, "_voted")
    spelling = F.struct(F.col("Test_Name").alias("name"), F.col("_hint").alias("hint"))
    seen = F.struct(F.col(ORDER).alias("o"), F.col("Aliases").alias("a"))
    facts = rows.withColumns({
        "_pick": best_spelling(spelling, F.col("_name_score"), F.col(ORDER)).over(group),
        "_seen": F.collect_list(F.when(F.col("_new"), seen)).over(group),
    })
    return facts.withColumns({
        "_canonical": F.col("_pick.name"), "_resolved": F.coalesce("_pick.hint", "_voted", F.lit("Other")),
    }).drop("_voted", "_new", "_pick")


def all_aliases() -> Column:
    """All aliases of a cluster in first-seen order, and its name."""
    seen = F.flatten(F.transform(F.array_sort("_seen"), lambda r: r["a"]))
    return va.unique_strings(F.concat(seen, F.array("_canonical")))


def cluster_facts(normalized: DataFrame, keys: list[str]) -> DataFrame:
    """Name, category and aliases of every cluster."""
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(ORDER))
    rows = with_cluster_facts(normalized.withColumn("_place", one), keys).where("_place = 1")
    return rows.select(*keys, "_canonical", "_resolved", all_aliases().alias("_all_aliases"))


def deduplicate(
    normalized: DataFrame, scope: list[str] | None = None, cluster: str = "_cluster", met: bool = False
) -> DataFrame:
    """Collapse normalized records to one per (scope, test, date text).

    The rows meet once, by cluster, and stay there for their places and facts.
    With ``met`` the caller has partitioned them by (some of) the scope, as fits
    documents, which are one value each; they stay where they are then.
    Rows without a scope or cluster belong to none.
    """
    scope = scope or [SCOPE]
    keys = [*scope, cluster]
    named = normalized.na.drop(subset=keys)
    placed_rows = with_reading_place(named if met else named.repartition(*keys), keys)
    joined = with_cluster_facts(placed_rows, keys).where("_place = 1").drop("_place")
    return (
        joined.withColumn(
            "Original_Test_Name",
            F.coalesce(F.col("Original_Test_Name"), strip(F.col("Test_Name")), "_canonical"),
        )
        .withColumn("Test_Name", F.col("_canonical"))
        .withColumn("Test_Category", F.col("_resolved"))
        .withColumn("Aliases", all_aliases())
        .drop("_canonical", "_resolved", "_seen")
    )


def resolve_records(df: DataFrame, scope: list[str] | None = None, met: bool = False, spelled_in: DataFrame | None = None) -> DataFrame:
    """Normalize, then deduplicate: the record table every report starts from.
    ``met``: as for :func:`deduplicate`; ``spelled_in``: as for :func:`normalize_records`.

    All text work is in one dictionary, so that a second pass over the rows, for
    the readings, costs less than writing them would.
    """
    out = deduplicate(normalize_records(df, spelled_in), scope, met=met)
    return out.drop(*HELPERS)


def in_report_order(df: DataFrame, scope: str = SCOPE) -> DataFrame:
    """Date order with unknown dates last, then test name."""
    return placed(
        df, scope, va.parse_sort_date(F.col("Test_Date")).asc_nulls_last(), "Test_Name", ORDER
    )
