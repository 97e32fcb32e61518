"""Priority findings and metrics: streaks, deviations, trends per test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.functions import names as nm
from labtrail.functions import status as st
from labtrail.functions import values as va
from labtrail.operators.dictionary import with_derived
from labtrail.operators.resolve import ORDER, SCOPE
from labtrail.session import materialize_by

KEYS = [SCOPE, "test_name"]
NO_DATE = "0001-01-01"


def finding_entries(records: DataFrame) -> DataFrame:
    """Typed findings with severity and deviation.  Unknown dates count as the
    oldest; tests without a usable name are left out."""
    source = records.select(
        SCOPE, ORDER, F.coalesce("Test_Name", "Original_Test_Name", F.lit(nm.UNKNOWN_TEST)).alias("_raw_name"),
        "Test_Category", "Result", "Unit", "Reference_Range", "Status", "Test_Date",
    )
    key = F.col("_key")
    named = with_derived(source, {
        "_raw_name": {"test_name": nm.client_test_name(key)},
        "Test_Category": {"category": nm.canonical_category(key)},
        "Status": {"_status": st.client_status(key), "_severity": st.severity3(key)},
    })
    ref = va.client_range(key)
    named = with_derived(named, {"Reference_Range": {"low": ref["low"], "high": ref["high"]}})
    day = F.coalesce(va.parse_client_date(key), F.lit(NO_DATE).cast("date"))
    named = with_derived(named, {"Test_Date": {"day": day}})
    typed = named.select(
        SCOPE, ORDER, "test_name", "category", F.col("Result").alias("value_text"),
        va.leading_numeric(F.col("Result")).alias("value"), F.col("Unit").alias("unit"),
        F.col("Reference_Range").alias("reference_range"), "low", "high",
        F.col("_status").alias("status"), F.col("_severity").alias("severity"),
        F.coalesce("Test_Date", F.lit("Unknown")).alias("report_date"), "day",
    )
    dev = va.deviation_percent(F.col("value"), F.col("low"), F.col("high"), F.col("severity"))
    return typed.where(F.col("test_name") != nm.UNKNOWN_TEST).withColumn("deviation", dev)


def _newest_first() -> Column:
    """Ascending key of 'newest first, input order on ties'."""
    return F.struct((-F.unix_date("day")).alias("d"), F.col(ORDER).alias("o"))


def _with_facts(rows: DataFrame, facts: DataFrame, how: str, met: bool) -> DataFrame:
    """Rows joined to ``facts`` (one row a scope and test).  Where both lie by scope (``met``) they meet
    by it, the facts of a scope as a list, and nothing is shuffled."""
    if not met:
        return rows.join(facts, KEYS, how)
    more = [c for c in facts.columns if c not in KEYS]
    listed = facts.groupBy(SCOPE).agg(F.collect_list(F.struct("test_name", *more)).alias("_listed"))
    own = F.try_element_at(F.filter("_listed", lambda x: x["test_name"] == F.col("test_name")), F.lit(1))
    found = rows.join(listed, SCOPE, how).withColumn("_own", own).drop("_listed")
    return (found if how == "left" else found.where("_own IS NOT NULL")).select(*rows.columns, *[F.col(f"_own.{c}").alias(c) for c in more])


def abnormal_streaks(entries: DataFrame, met: bool = False) -> DataFrame:
    """Abnormal readings newer than the newest normal one.

    The newest normal reading is a partially aggregated minimum; the readings
    before it are counted after an equi join, so no task sorts a whole group.
    """
    stop = entries.where("severity = 'NORMAL'").groupBy(*KEYS).agg(F.min(_newest_first()).alias("_stop"))
    abnormal = entries.where("severity <> 'NORMAL'").select(*KEYS, _newest_first().alias("_at"))
    return (
        _with_facts(abnormal, stop, "left", met)
        .where(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))
        .groupBy(*KEYS).agg(n_rows().alias("streak"))
    )


def most_deviant(entries: DataFrame) -> DataFrame:
    """Most deviant reading per test, worst severity first, then input order."""
    row = F.struct("value_text", "unit", "reference_range", "severity", "status", "report_date", "deviation", ORDER)
    key = F.struct(-F.col("deviation"), -st.severity3_rank(F.col("severity")), F.col(ORDER))
    return entries.groupBy(*KEYS).agg(F.min_by(row, key).alias("r")).select(*KEYS, "r.*")


def top_per_scope(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows per scope; the rank filter is applied before the shuffle."""
    w = Window.partitionBy(SCOPE).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def priority_findings(entries: DataFrame, k: int = 8, met: bool = False) -> DataFrame:
    worst = F.struct("value_text", "severity", "status", "report_date", "deviation")
    latest = F.struct("value_text", "severity", "report_date")
    by_deviation = F.struct(-F.col("deviation"), -st.severity3_rank(F.col("severity")), F.col(ORDER))
    groups = entries.groupBy(*KEYS).agg(
        F.min_by(worst, by_deviation).alias("w"), F.min_by(latest, _newest_first()).alias("l"),
        n_rows().alias("total_reports"), F.count_if(F.col("severity") != "NORMAL").alias("abnormal_count"),
        F.min(ORDER).alias("_first"),
    ).where("abnormal_count > 0")
    scored = _with_facts(groups, abnormal_streaks(entries, met), "left", met).withColumn("streak", F.coalesce("streak", F.lit(0)))
    points = F.when(F.col("w.severity") == "HIGH", 100).when(F.col("w.severity") == "BORDERLINE", 50).otherwise(10)
    flat = scored.select(
        *KEYS, F.col("w.value_text").alias("worst_value"), F.col("w.severity").alias("severity"),
        F.col("w.status").alias("status"), F.col("w.report_date").alias("worst_date"),
        F.col("l.value_text").alias("latest_value"), F.col("l.report_date").alias("latest_date"),
        F.col("l.severity").alias("latest_severity"), "total_reports", "abnormal_count", "streak",
        (points + F.col("streak") * 25 + F.col("w.deviation")).cast("bigint").alias("score"), "_first",
    )
    return top_per_scope(flat, [F.desc("score"), F.asc("_first")], k).drop("_first")


def latest_two(entries: DataFrame) -> DataFrame:
    """Latest and previous reading of every test and the trend between them."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("day"), F.asc(ORDER))
    two = entries.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    pair = two.groupBy(*KEYS).agg(
        F.max(F.when(F.col("_rn") == 1, F.struct("value_text", "value", "unit", "low", "high", "status", "severity", "report_date"))).alias("l"),
        F.max(F.when(F.col("_rn") == 2, F.col("value"))).alias("previous"),
    )
    delta = F.round(F.col("l.value") - F.col("previous"), 2)
    limit = va.trend_threshold(F.col("l.low"), F.col("l.high"), F.col("previous"))
    falling_is_good = nm.lower_is_better(F.col("test_name"))
    trend = (
        F.when(delta.isNull(), "insufficient_data").when(F.abs(delta) <= limit, "stable")
        .when(falling_is_good == (delta < 0), "improving").otherwise("worsening")
    )
    return pair.select(
        *KEYS, F.col("l.value_text").alias("latest_value"), F.col("l.report_date").alias("latest_date"),
        F.col("l.status").alias("latest_status"), F.col("l.severity").alias("latest_severity"),
        delta.alias("trend_delta"), trend.alias("trend"), falling_is_good.alias("lower_is_better"),
    )


def priority_metrics(entries: DataFrame, k: int = 6, met: bool = False) -> DataFrame:
    counts = entries.groupBy(*KEYS).agg(n_rows().alias("report_count"), F.min(ORDER).alias("_first"))
    rows = _with_facts(latest_two(entries), counts, "inner", met)
    order = [
        F.desc(F.col("latest_severity") != "NORMAL"), F.desc(F.col("trend") == "worsening"),
        F.desc("report_count"), F.asc("_first"),
    ]
    return top_per_scope(rows, order, k).drop("_first")


def structured_review(entries: DataFrame) -> DataFrame:
    """Totals, most affected category and the facts the advice lines rest on.

    Entries are written once, those of a scope together: all of it reads them there, without a shuffle."""
    entries = materialize_by(entries, "entries-by-scope", SCOPE)
    totals = entries.groupBy(SCOPE).agg(
        n_rows().alias("records"), F.count_if(F.col("severity") != "NORMAL").alias("total_alerts"),
        F.countDistinct("report_date").alias("report_dates"),
    )
    alerts = entries.where("severity <> 'NORMAL'").groupBy(SCOPE, "category").agg(n_rows().alias("n"), F.min(ORDER).alias("o"))
    worst = alerts.groupBy(SCOPE).agg(F.min_by("category", F.struct(-F.col("n"), F.col("o"))).alias("c"))
    streaks = priority_findings(entries, met=True).groupBy(SCOPE).agg(F.max(F.col("streak") >= 2).alias("s"))
    trends = priority_metrics(entries, met=True).groupBy(SCOPE).agg(F.max(F.col("trend") == "worsening").alias("t"))
    no = F.lit(False)
    out = totals.join(worst, SCOPE, "left").join(streaks, SCOPE, "left").join(trends, SCOPE, "left").select(
        SCOPE, "records", "total_alerts", "report_dates",
        F.coalesce("c", F.lit("No category alerts")).alias("most_affected_category"),
        F.coalesce("s", no).alias("has_streak"), F.coalesce("t", no).alias("has_worsening"),
    )
    lines = F.array(
        F.when(F.col("has_streak"), "Sustained abnormal run across reports: ask a clinician to review.").otherwise("No sustained abnormal run among the top findings."),
        F.when(F.col("has_worsening"), "At least one key metric got worse since its last reading.").otherwise("Key metrics are steady or better than at their last reading."),
        F.lit("Read latest and worst values side by side."),
    )
    return out.withColumn("recommendations", F.array_join(lines, " | "))
