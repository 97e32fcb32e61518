"""Filters, facets, slices, unions and distinct rows of the record table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.functions import status as st
from labtrail.functions import text as tx
from labtrail.functions import values as va
from labtrail.functions.basic import blank_to_null, placed
from labtrail.operators.insights import body_parts
from labtrail.operators.resolve import ORDER, SCOPE
from labtrail.schema import union_padded



def drop_empty(df: DataFrame) -> DataFrame:
    """Rows with neither a test name nor a result carry nothing."""
    return df.na.drop(how="all", subset=["Test_Name", "Result"])


def with_typed_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("Result_Numeric", va.strict_numeric(F.col("Result"))).withColumn(
        "Test_Date_dt", va.parse_date_day_first(F.col("Test_Date"))
    )


def in_date_order(df: DataFrame) -> DataFrame:
    return placed(
        df, SCOPE, F.col("Test_Date_dt").asc_nulls_last(), F.col("Test_Category").asc_nulls_last(),
        F.col("Test_Name").asc_nulls_last(), ORDER,
    )


# --- facets and search ------------------------------------------------------
def facet_rows(df: DataFrame, body_part: str | None = None, category: str | None = None, test: str | None = None) -> DataFrame:
    """Records left after the facets picked so far."""
    name = F.col("Test_Name")
    out = df.where(name.isNotNull() & ~name.isin("N/A", "UnknownTest", "Unknown Test")).withColumn(
        "Test_Category", F.coalesce("Test_Category", F.lit("Other"))
    )
    if body_part and body_part != "General":
        out = out.where(F.array_contains(body_parts(F.col("Test_Category")), body_part))
    if category:
        out = out.where(F.col("Test_Category") == category)
    return out.where(name == test) if test else out


def facet_values(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Distinct values of one facet, sorted."""
    order = F.desc(column) if descending else F.asc(column)
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(order)


def search(df: DataFrame, text: str) -> DataFrame:
    """Keep a whole category when its name matches, else matching tests."""
    q = text.strip().lower()
    cat = F.coalesce(blank_to_null(F.col("Test_Category")), F.lit("Uncategorized"))
    hit = F.contains(F.lower(cat), F.lit(q)) | F.contains(F.lower("Test_Name"), F.lit(q))
    named = df.where(F.col("Test_Name").isNotNull() & (F.col("Test_Name") != "N/A"))
    return named.where(hit) if q else named


# --- source files -----------------------------------------------------------
FILE_COLUMNS = ["Source_Filename", "source_filename", "sourceFileName", "Source Filename"]


def source_file(df: DataFrame) -> Column:
    found = [blank_to_null(F.col(f"`{c}`")) for c in FILE_COLUMNS if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def with_source_file(df: DataFrame, file_name: Column) -> DataFrame:
    return df.withColumn("Source_Filename", F.coalesce(source_file(df), file_name))


def _keep_best(rows: DataFrame, level: Column, report: str) -> DataFrame:
    """Rows at the best match level of their report: rows that were joined to
    their report stay where they are, and the join is done once."""
    best = F.min("_level").over(Window.partitionBy(report))
    return rows.withColumn("_level", level).withColumn("_best", best).where("_level = _best").drop("_level", "_best")


def slice_by_file(rows: DataFrame, reports: DataFrame, fallback_to_all: bool, report: str = "report_id") -> DataFrame:
    """Rows whose base file name is the report's; optionally all when none is."""
    j = rows.join(reports.select(report, F.col("file_name").alias("_file")), report)
    target = tx.file_key(F.col("_file"))
    exact = (target == "") | (tx.file_key(source_file(j)) == target)
    if not fallback_to_all:
        return j.where(exact).drop("_file")
    return _keep_best(j, F.when(exact, 1).otherwise(2), report).drop("_file")


def slice_deterministic(rows: DataFrame, reports: DataFrame | None = None, report: str = "report_id") -> DataFrame:
    """Exact file, else stems equal or one inside the other, else all rows.

    Without ``reports`` the rows have their report's file in ``_file``."""
    j = rows if reports is None else rows.join(reports.select(report, F.col("file_name").alias("_file")), report)
    target, own = tx.file_key(F.col("_file")), tx.file_key(source_file(j))
    t, o = tx.file_stem(target), tx.file_stem(own)
    near = (o != "") & (t != "") & (F.contains(t, o) | F.contains(o, t))
    level = F.when((target == "") | (own == target), 1).when(near, 2).otherwise(3)
    return _keep_best(j, level, report).drop("_file")


# --- output cleaning --------------------------------------------------------
def cleaned_for_output(df: DataFrame) -> DataFrame:
    """NaN becomes null, dates and timestamps become ISO text."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd'T'00:00:00")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- unions and distinct rows ----------------------------------------------
def combine(existing: DataFrame, new: DataFrame, pad: str | None = None) -> DataFrame:
    """Existing rows plus new rows; columns only one side has are padded."""
    if pad is None:
        return union_padded(existing, new)
    names = existing.columns + [c for c in new.columns if c not in existing.columns]
    fill = lambda df: df.select(
        *[F.col(c) if c in df.columns else F.lit(pad).alias(c) for c in names]
    )
    return fill(existing).unionByName(fill(new))


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per identical content (a record's order key is not content)."""
    columns = columns or [c for c in df.columns if c != ORDER]
    rest = [c for c in df.columns if c not in columns]
    picked = F.min_by(F.struct(*rest), F.col(ORDER)).alias("_r")
    return df.groupBy(*columns).agg(picked).select(*columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def combine_duplicate_tests(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Best category per test (most dates, most rows, name), then one row per
    test and date.

    The rows meet once, by test; columns that nobody reads are not shuffled."""
    keys = [*(scope or [SCOPE]), "Test_Name"]
    order = [*keys, "Test_Date", "Test_Category"]
    rest = [c for c in df.columns if c not in order]
    # where a date comes first in its group the row stands for it
    first = lambda *cols: F.row_number().over(Window.partitionBy(*keys, *cols).orderBy(ORDER)) == 1
    alike, test = Window.partitionBy(*keys, "Test_Category"), Window.partitionBy(*keys)
    rows = df.repartition(*keys).withColumn("_one", first("Test_Date")).withColumn("_date", first("Test_Category", "Test_Date") & F.col("Test_Date").isNotNull())
    rows = rows.withColumns({"_d": F.count_if("_date").over(alike), "_n": n_rows().over(alike)})
    ballot = F.struct((-F.col("_d")).alias("d"), (-F.col("_n")).alias("n"), F.col("Test_Category").alias("c"))
    named = reduce(and_, [F.col(k).isNotNull() for k in keys])
    best = F.min(F.when(named & F.col("Test_Category").isNotNull(), ballot)).over(test)
    return rows.withColumn("_best", best).where("_one").select(*keys, "Test_Date", F.col("_best.c").alias("Test_Category"), *rest)


def category_counts(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct dates and rows per test and category."""
    return df.groupBy(*(scope or [SCOPE]), "Test_Name", "Test_Category").agg(
        F.countDistinct("Test_Date").alias("date_count"), n_rows().alias("row_count")
    )


def consistency_report(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Missing critical fields, unreadable dates, repeated test dates."""
    scope = scope or [SCOPE]
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == "N/A"))
    per_group = df.groupBy(*scope, "Test_Name", "Test_Date").agg(
        n_rows().alias("n"), missing("Result").alias("r"),
    )
    bad_date = va.parse_date_day_first(F.col("Test_Date")).isNull() & (F.col("Test_Date") != "N/A")
    group_n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    gone = lambda c: F.col(c).isNull() | (F.col(c) == "N/A")
    both = F.col("Test_Name").isNotNull() & F.col("Test_Date").isNotNull()
    totals = per_group.groupBy(*scope).agg(
        group_n(gone("Test_Name")).alias("Missing Test_Name"),
        F.sum("r").alias("Missing Result"),
        group_n(gone("Test_Date")).alias("Missing Test_Date"),
        group_n(bad_date).alias("Invalid date formats"),
        F.count_if((F.col("n") > 1) & both).alias("Duplicate test dates"),
    )
    kinds = [c for c in totals.columns if c not in scope]
    return totals.unpivot(scope, kinds, "issue", "records").where("records > 0")


def records_per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("Source_Filename").agg(n_rows().alias("records"))


# --- chat history -----------------------------------------------------------
def clean_turns(turns: DataFrame) -> DataFrame:
    role = F.lower(F.trim("role"))
    return turns.withColumn("role", role).withColumn("text", blank_to_null(F.col("text"))).where(
        role.isin("user", "assistant") & F.col("text").isNotNull()
    )


def last_turns(turns: DataFrame, keep: int = 8) -> DataFrame:
    """Last N turns per session.  The rank filter is pushed below the shuffle
    (group-limited window), so a huge session sends N rows per map task."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


# --- tree of tests ----------------------------------------------------------
def organized_tree(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every test with its category's alert count and the keys that order it."""
    scope = scope or [SCOPE]
    cat = F.coalesce(blank_to_null(F.col("Test_Category")), F.lit("Uncategorized"))
    named = df.where(F.col("Test_Name").isNotNull() & (F.col("Test_Name") != "N/A")).withColumn("category", cat)
    abnormal = st.abnormal_tree(F.col("Status"))
    alerts = named.groupBy(*scope, "category").agg(F.count_if(abnormal).alias("alert_count"))
    return named.join(alerts, [*scope, "category"]).select(
        *scope, "category", "alert_count", "Test_Name", ORDER,
        F.when(abnormal, 0).otherwise(1).alias("abnormal_rank"),
        st.tree_rank(F.col("Status")).alias("severity_rank"),
        va.parse_client_date(F.col("Test_Date")).alias("day"),
    )


def in_tree_order(tree: DataFrame) -> DataFrame:
    return placed(
        tree, SCOPE, F.desc("alert_count"), "category", "abnormal_rank", "severity_rank",
        F.col("day").asc_nulls_last(), "Test_Name", ORDER,
    )
