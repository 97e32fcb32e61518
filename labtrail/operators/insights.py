"""Health scores, body systems, alerts, dashboards (per scope).

Every result is a grouped aggregate with map-side partial sums; detail lists
stay in long form (one row per finding) instead of arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail import fixed_values as fv
from labtrail.functions import status as st
from labtrail.functions import values as va
from labtrail.functions.basic import blank_to_null, constant_rows, placed
from labtrail.functions.text import clean_lab
from labtrail.operators.dictionary import with_derived
from labtrail.operators.resolve import ORDER, SCOPE
from labtrail.session import materialize



def count_if(c: Column) -> Column:
    return F.count_if(c)


def _weight_score(null_weight: int) -> Column:
    total = F.sum(st.status_weight(F.col("Status"), null_weight))
    return F.floor(total / n_rows()).cast("bigint")


def overall_score(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Mean status weight, truncated; a missing status weighs nothing."""
    scope = scope or [SCOPE]
    return records.groupBy(*scope).agg(_weight_score(0).alias("overall_score"), n_rows().alias("total_tests"))


def _has_category() -> Column:
    return F.col("Test_Category").isNotNull() & (F.col("Test_Category") != "N/A")


def category_scores(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    return (
        records.where(_has_category())
        .groupBy(*scope, "Test_Category")
        .agg(
            _weight_score(fv.OTHER_STATUS_WEIGHT).alias("score"),
            n_rows().alias("total_tests"),
            count_if(st.abnormal_score(F.col("Status"))).alias("abnormal_count"),
        )
    )


def concerns(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per abnormal finding."""
    scope = scope or [SCOPE]
    kept = records.where(st.abnormal_score(F.col("Status")))
    return kept.select(
        *scope, ORDER,
        F.col("Test_Name").alias("test_name"), F.col("Result").alias("result"),
        F.col("Status").alias("status"), F.col("Reference_Range").alias("reference"),
        F.col("Test_Category").alias("category"), F.col("Test_Date").alias("date"),
    )


def first_concerns(concern_rows: DataFrame, k: int = 8, scope: list[str] | None = None) -> DataFrame:
    """The first concerns of each scope, numbered; ranks are cut before the shuffle."""
    return placed(concern_rows, scope or [SCOPE], ORDER).where(F.col("place") <= k)


def body_parts(category: Column) -> Column:
    """Body parts of a category; ``General`` for one the table lacks."""
    rows = constant_rows("c string, p array<string>", fv.BODY_PARTS)
    found = F.try_element_at(F.filter(rows, lambda r: r["c"] == category), F.lit(1))["p"]
    return F.coalesce(found, F.array(F.lit("General")))


def body_systems(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Totals per body part; flagged when half of the findings are abnormal.

    Rows are counted per category first, so only category totals are exploded
    into body parts.
    """
    scope = scope or [SCOPE]
    per_category = category_scores(records, scope)
    parts = per_category.withColumn("system", F.explode(body_parts(F.col("Test_Category"))))
    out = parts.groupBy(*scope, "system").agg(
        F.sum("abnormal_count").alias("abnormal_count"),
        F.sum("total_tests").alias("total_count"),
        F.array_join(F.array_sort(F.collect_set("Test_Category")), "|").alias("categories"),
    )
    ratio = F.col("abnormal_count") / F.col("total_count")
    level = F.when(ratio >= 0.5, "flagged").otherwise("normal")
    symbols = constant_rows("p string, s string", fv.BODY_PART_SYMBOL.items())
    return out.select(
        *scope, "system",
        F.coalesce(
            F.try_element_at(F.filter(symbols, lambda r: r["p"] == F.col("system")), F.lit(1))["s"],
            F.lit(fv.DEFAULT_SYMBOL),
        ).alias("emoji"),
        level.alias("concern_level"),
        F.when(ratio >= 0.5, 2).otherwise(1).alias("concern_score"),
        "abnormal_count", "total_count", ratio.alias("abnormal_ratio"), "categories",
    )


def body_system_tests(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The findings behind each body part, one row each."""
    scope = scope or [SCOPE]
    kept = records.where(_has_category())
    return kept.select(
        *scope, ORDER, F.explode(body_parts(F.col("Test_Category"))).alias("system"),
        F.col("Test_Name").alias("name"), F.col("Result").alias("result"),
        F.col("Status").alias("status"), F.col("Test_Category").alias("category"),
    )


def most_concerning_first(systems: DataFrame) -> DataFrame:
    return placed(systems, SCOPE, F.desc("concern_score"), F.desc("abnormal_count"), "system")


def migration_category_scores(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Share of findings that are not abnormal, per category."""
    scope = scope or [SCOPE]
    cat = F.coalesce(blank_to_null(F.col("Test_Category")), F.lit("Other"))
    bad = count_if(st.abnormal_migration(st.normalize_status(F.col("Status"))))
    return records.groupBy(*scope, cat.alias("Test_Category")).agg(
        F.greatest(F.lit(0), va.js_round((n_rows() - bad) / n_rows() * 100)).cast("bigint").alias("score"),
        n_rows().alias("total_tests"), bad.alias("abnormal_count"),
    )


def migration_overall(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    return migration_category_scores(records, scope).groupBy(*scope).agg(
        va.js_round(F.sum("score") / n_rows()).cast("bigint").alias("overall_score")
    )


def alerts_by_category(concern_rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    s = F.lower(F.coalesce(blank_to_null(F.col("status")), F.lit("")))
    cat = F.coalesce(blank_to_null(F.col("category")), F.lit("Uncategorized"))
    out = concern_rows.groupBy(*scope, cat.alias("category")).agg(
        n_rows().alias("total_alerts"),
        count_if(s == "critical").alias("critical_count"),
        count_if(s.isin("high", "positive", "flagged")).alias("high_count"),
        count_if(s == "low").alias("low_count"),
        count_if(~s.isin("critical", "high", "positive", "flagged", "low")).alias("normal_count"),
    )
    severity = (
        F.when(F.col("critical_count") > 0, "critical").when(F.col("high_count") > 0, "high")
        .when(F.col("low_count") > 0, "low").otherwise("normal")
    )
    return out.withColumn("severity", severity)


def most_severe_first(alerts: DataFrame) -> DataFrame:
    rank = F.expr("array_position(array('critical', 'high', 'low', 'normal'), severity)")
    return placed(alerts, SCOPE, rank, F.desc("total_alerts"), "category")


def critical_total(alerts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return alerts.groupBy(*(scope or [SCOPE])).agg(F.sum("critical_count").alias("critical_total"))


def distinct_reports(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct source files per scope, never below one."""
    return records.groupBy(*(scope or [SCOPE])).agg(
        F.greatest(F.lit(1), F.countDistinct("Source_Filename")).alias("report_count")
    )


# --- per date / per category counts ----------------------------------------
def alert_trend(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    day = F.coalesce(blank_to_null(F.col("Test_Date")), F.lit("Unknown"))
    return records.groupBy(*scope, day.alias("date")).agg(
        count_if(st.abnormal_panel(F.col("Status"))).alias("alert_count"), n_rows().alias("total_count")
    )


def category_comparison(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    return (
        records.where(st.abnormal_panel(F.col("Status")))
        .groupBy(*scope, F.col("Test_Category").alias("category"))
        .agg(n_rows().alias("alerts"))
    )


def trend_by_date(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    bad = count_if(st.abnormal_dash(F.col("Status")))
    return records.groupBy(*scope, F.coalesce("Test_Date", F.lit("Unknown")).alias("date")).agg(
        n_rows().alias("total"), bad.alias("concerning"), count_if(st.good(F.col("Status"))).alias("good"),
        va.js_round(bad / n_rows() * 100).cast("bigint").alias("concerning_percent"),
    )


def counters(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Headline counters and the clinical state they imply."""
    scope = scope or [SCOPE]
    status = F.col("Status")
    out = records.groupBy(*scope).agg(
        n_rows().alias("records"),
        count_if(st.good(status)).alias("normal"),
        count_if(st.abnormal_dash(status)).alias("concerning"),
        count_if(F.lower(status) == "critical").alias("critical"),
        count_if(st.abnormal_panel(status)).alias("alerts"),
        F.countDistinct(blank_to_null(F.col("Source_Filename"))).alias("sources"),
    )
    rate = va.js_round(F.col("alerts") / F.col("records") * 100).cast("bigint")
    state = (
        F.when(F.col("critical") > 0, "Attention Required").when(rate >= 30, "Monitor Closely")
        .otherwise("Generally Stable")
    )
    return out.withColumn("alert_rate", rate).withColumn("clinical_state", state)


def trend_narrative(trend: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """First against last alert count over the dates of :func:`alert_trend`.

    Unknown dates come last; the date text breaks ties.
    """
    scope = scope or [SCOPE]
    order = F.struct(
        F.coalesce(va.parse_client_date(F.col("date")), F.lit("9999-12-31").cast("date")), F.col("date")
    )
    out = trend.groupBy(*scope).agg(
        n_rows().alias("dates"), F.min_by("alert_count", order).alias("first_alerts"),
        F.max_by("alert_count", order).alias("last_alerts"),
    )
    delta = F.col("last_alerts") - F.col("first_alerts")
    pct = F.when(F.col("first_alerts") == 0, F.when(F.col("last_alerts") > 0, 100).otherwise(0)).otherwise(
        va.js_round(delta / F.col("first_alerts") * 100)
    ).cast("bigint")
    direction = (
        F.when(F.col("dates") == 1, "single date").when(delta == 0, "stable")
        .when(delta > 0, "increasing").otherwise("decreasing")
    )
    return out.withColumn("percent_change", F.abs(pct)).withColumn("direction", direction)


def score_band(scores: DataFrame, systems: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    counts = systems.groupBy(*scope).agg(
        count_if(F.col("concern_level") == "flagged").alias("flagged_systems"),
        count_if(F.col("concern_level") == "normal").alias("normal_systems"),
    )
    band = (
        F.when(F.col("overall_score") >= 80, "Good").when(F.col("overall_score") >= 60, "Fair")
        .otherwise("Needs Review")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return scores.join(counts, scope, "left").select(
        *scope, "overall_score", band.alias("band"), zero("flagged_systems"), zero("normal_systems")
    )


# --- organized tables behind the workbook ----------------------------------
def valid_for_display(records: DataFrame, non_blank_result: bool = False) -> DataFrame:
    name, result = F.col("Test_Name"), F.col("Result")
    keep = name.isNotNull() & (name != "N/A") & result.isNotNull()
    if non_blank_result:
        keep = keep & (blank_to_null(name).isNotNull()) & (blank_to_null(result).isNotNull())
    return records.where(keep)


def date_lab(clean: bool = True) -> Column:
    lab = clean_lab(F.col("Lab_Name")) if clean else F.coalesce("Lab_Name", F.lit("Unknown Lab"))
    return F.concat(F.coalesce("Test_Date", F.lit("Unknown Date")), F.lit("_"), lab)


def organized_cells(records: DataFrame, scope: list[str] | None = None, value: str = "Result") -> DataFrame:
    """Long form of the organized table: first value per test and date-lab."""
    scope = scope or [SCOPE]
    keys = [*scope, "Test_Category", "Test_Name", date_lab().alias("date_lab")]
    kept = valid_for_display(records).where(F.col(value).isNotNull() & F.col("Test_Category").isNotNull())
    return kept.groupBy(*keys).agg(F.min_by(value, ORDER).alias(value))


def column_ranks(cells: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Place of every date-lab among the columns of its scope: by date, unknown
    dates first, then by name.  With it the long form has any width."""
    scope = scope or [SCOPE]
    day = va.parse_date_day_first(F.element_at(F.split("date_lab", "_"), 1))
    w = Window.partitionBy(*scope).orderBy(day.asc_nulls_first(), "date_lab")
    return cells.select(*scope, "date_lab").distinct().withColumn("place", F.row_number().over(w))


def organized_table(cells: DataFrame, columns: list[str], scope: list[str] | None = None, value: str = "Result") -> DataFrame:
    """Wide form; cells are unique, so the pivot only moves values."""
    scope = scope or [SCOPE]
    return cells.groupBy(*scope, "Test_Category", "Test_Name").pivot("date_lab", columns).agg(F.min(value))


def with_header_rows(wide: DataFrame, columns: list[str], scope: list[str] | None = None) -> DataFrame:
    """The wide form with two rows on top of each scope, naming the date and the
    laboratory of every column; ``place`` keeps them there: 0, 1, then 2."""
    scope = scope or [SCOPE]
    parts = [(c, c.partition("_")) for c in columns]

    def header(place: int, title: str, text) -> Column:
        cells = [F.lit(text(p)).alias(c) for c, p in parts]
        return F.struct(F.lit(place).alias("place"), F.lit(title).alias("Test_Category"), F.lit("").alias("Test_Name"), *cells)

    heads = F.array(header(0, "📅 Date", lambda p: p[0]), header(1, "🏥 Lab", lambda p: p[2] or "N/A"))
    top = wide.select(*scope).distinct().withColumn("_h", F.explode(heads)).select(*scope, "_h.*")
    return top.unionByName(wide.select(*scope, F.lit(2).alias("place"), "Test_Category", "Test_Name", *[F.col(f"`{c}`") for c in columns]))


def common_ranges(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Most frequent printed range per test over the organized cells."""
    scope = scope or [SCOPE]
    cells = organized_cells(records, scope, "Reference_Range")
    r = F.col("Reference_Range")
    day = va.parse_date_day_first(F.element_at(F.split("date_lab", "_"), 1))
    first = F.struct(F.coalesce(day, F.lit("0001-01-01").cast("date")).alias("d"), F.col("date_lab"))
    counted = (
        cells.where((F.trim(r) != "") & (r != "N/A"))
        .groupBy(*scope, "Test_Category", "Test_Name", "Reference_Range")
        .agg(n_rows().alias("n"), F.min(first).alias("first"))
    )
    return counted.groupBy(*scope, "Test_Category", "Test_Name").agg(
        F.min_by("Reference_Range", F.struct(-F.col("n"), F.col("first"))).alias("Reference_Range")
    )


def workbook_summary(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Categories, tests, charts, dates and laboratories of each scope's workbook.

    The date-labs of a scope are the same whatever value a cell takes: they are
    collected without values, and a name's date and laboratory are read once a name."""
    scope = scope or [SCOPE]
    cells = organized_cells(records, scope)
    per_test = cells.groupBy(*scope, "Test_Category", "Test_Name").agg(
        F.count(va.strict_numeric(F.col("Result"))).alias("points")
    )
    charts = per_test.groupBy(*scope).agg(
        F.countDistinct("Test_Category").alias("categories"), n_rows().alias("tests"),
        count_if(F.col("points") > 1).alias("charts"),
    )
    shown = valid_for_display(records).where(F.col("Test_Category").isNotNull())
    seen = shown.select(*scope, "Test_Date", "Lab_Name").distinct().select(*scope, date_lab().alias("date_lab"))
    date, key = F.element_at(F.split("_key", "_"), 1), F.col("_key")
    named = with_derived(materialize(seen.distinct(), "date-labs"), {"date_lab": {
        "_day": F.coalesce(va.parse_date_day_first(date), F.lit("0001-01-01").cast("date")), "_date": date, "_lab": F.regexp_replace(key, "^[^_]*_", "")}})
    order = F.struct("_day", "date_lab")
    dates = named.groupBy(*scope).agg(
        n_rows().alias("date_labs"), F.min_by("_date", order).alias("first_date"), F.max_by("_date", order).alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("_lab")), "|").alias("labs"),
    )
    return charts.join(dates, scope)


def tests_per_category(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or [SCOPE]
    return (
        organized_cells(records, scope).select(*scope, "Test_Category", "Test_Name").distinct()
        .groupBy(*scope, "Test_Category").agg(n_rows().alias("tests"))
    )


def chart_series(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Numeric points of every test that has more than one, with its limits and
    the padded value axis."""
    scope = scope or [SCOPE]
    keys = [*scope, "Test_Category", "Test_Name"]
    points = organized_cells(records, scope).withColumn("value", va.strict_numeric(F.col("Result"))).where("value IS NOT NULL")
    ranges = organized_cells(records, scope, "Reference_Range")
    r = F.col("Reference_Range")
    day = va.parse_date_day_first(F.element_at(F.split("date_lab", "_"), 1))
    first = F.struct(F.coalesce(day, F.lit("0001-01-01").cast("date")), F.col("date_lab"))
    limits = ranges.where((F.trim(r) != "") & (r != "N/A")).groupBy(*keys).agg(F.min_by("Reference_Range", first).alias("ref"))
    span = points.groupBy(*keys).agg(n_rows().alias("points"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("points > 1")
    ref = va.reference_range(F.col("ref"))
    facts = span.join(limits, keys, "left").select(
        *keys, ref["low"].alias("low"), ref["high"].alias("high"),
        F.least("lo", ref["low"], ref["high"]).alias("bottom"),
        F.greatest("hi", ref["low"], ref["high"]).alias("top"),
    )
    return points.join(facts, keys).select(
        *keys, "date_lab", "value", "low", "high", *_padded_axis("bottom", "top", 0.15)
    )


def _padded_axis(bottom: str, top: str, share: float) -> list[Column]:
    lo, hi = F.col(bottom), F.col(top)
    width = F.when(lo != hi, hi - lo).otherwise(hi * 0.1)
    return [
        F.when(width > 0, lo - width * share).otherwise(lo * 0.85).alias("y_min"),
        F.when(width > 0, hi + width * share).otherwise(hi * 1.15).alias("y_max"),
    ]


def latest_range(records: DataFrame, keys: list[str]) -> DataFrame:
    """Reference range of the latest numeric reading of each test."""
    day = va.parse_date_day_first(F.col("Test_Date"))
    numeric = records.where(va.strict_numeric(F.col("Result")).isNotNull())
    return numeric.groupBy(*keys).agg(
        F.max_by("Reference_Range", F.struct(day.isNull().alias("u"), day.alias("d"), F.col(ORDER))).alias("ref")
    )


def normalized_values(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Value as a percentage of the middle of the latest printed range."""
    keys = [*(scope or [SCOPE]), "Test_Name"]
    ref = va.reference_range(F.col("ref"))
    limits = latest_range(records, keys).select(*keys, ref["low"].alias("low"), ref["high"].alias("high"), ref["kind"].alias("kind"))
    mid = (F.col("low") + F.col("high")) / 2
    usable = (F.col("kind") == "range") & (mid != 0)
    rows = records.withColumn("value", va.strict_numeric(F.col("Result"))).where("value IS NOT NULL")
    pct = lambda c: F.when(usable, F.col(c) / mid * 100)
    return rows.join(limits, keys).select(
        *keys, ORDER, "value", F.coalesce(pct("value"), F.when(~F.coalesce(usable, F.lit(False)), F.col("value"))).alias("normalized"),
        pct("low").alias("low_limit"), pct("high").alias("high_limit"),
    )


def plot_axis(records: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Value axis of a trend plot: ten per cent beyond data and limits."""
    keys = [*(scope or [SCOPE]), "Test_Name"]
    ref = va.reference_range(F.col("ref"))
    limits = latest_range(records, keys).select(*keys, ref["low"].alias("low"), ref["high"].alias("high"), ref["kind"].alias("kind"))
    rows = records.withColumn("value", va.strict_numeric(F.col("Result"))).where("value IS NOT NULL")
    span = rows.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = span.join(limits, keys)
    lo, hi, low, high = (F.col(c) for c in ("lo", "hi", "low", "high"))
    width = hi - lo
    pad = lambda alt, share=0.1: F.abs(F.when(width > 0, width * share).otherwise(alt * share))
    kind = F.col("kind")
    y_min = (
        F.when(kind == "range", F.least(lo, low) - pad(low))
        .when(kind == "less_than", F.least(lo, F.lit(0.0)) - pad(lo))
        .when(kind == "greater_than", F.least(lo, low) - pad(low))
        .otherwise(lo - pad(hi, 0.15))
    )
    y_max = (
        F.when(kind == "range", F.greatest(hi, high) + pad(high))
        .when(kind == "less_than", F.greatest(hi, high) + pad(high))
        .when(kind == "greater_than", F.greatest(hi, hi * 1.2) + pad(hi))
        .otherwise(hi + pad(hi, 0.15))
    )
    return j.select(*keys, "kind", y_min.alias("y_min"), y_max.alias("y_max"))


def gauge_axis(value: Column, ref: Column) -> tuple[Column, Column]:
    """Axis of a single-reading gauge."""
    low, high, kind = ref["low"], ref["high"], ref["kind"]
    span = (high - low) * 0.2
    around = F.when(value != 0, F.abs(value * 0.5)).otherwise(10)
    lo = (
        F.when(kind == "range", F.least(low - span, value - span)).when(kind == "less_than", F.lit(0.0))
        .when(kind == "greater_than", F.least(low * 0.5, value * 0.8)).otherwise(value - around)
    )
    hi = (
        F.when(kind == "range", F.greatest(high + span, value + span))
        .when(kind == "less_than", F.greatest(high * 1.5, value * 1.2))
        .when(kind == "greater_than", F.greatest(low * 1.5, value * 1.2)).otherwise(value + around)
    )
    return lo, hi
