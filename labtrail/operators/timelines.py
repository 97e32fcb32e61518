"""Timelines, latest values, report history and chat context (per scope)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.functions import names as nm
from labtrail.functions import status as st
from labtrail.functions import text as tx
from labtrail.functions import values as va
from labtrail.functions.basic import blank_to_null
from labtrail.operators.dictionary import with_derived
from labtrail.operators.insights import valid_for_display
from labtrail.operators.panel import top_per_scope
from labtrail.operators.resolve import ORDER, SCOPE
from labtrail.session import materialize_by

FAR = "9999-12-31"


def _day(parsed: Column) -> Column:
    """Date for ordering; unknown dates come last."""
    return F.coalesce(parsed, F.lit(FAR).cast("date"))


def client_day() -> Column:
    return _day(va.parse_client_date(F.col("Test_Date")))


# --- long timelines ---------------------------------------------------------
def by_date_and_category(records: DataFrame) -> DataFrame:
    """Rows of the date -> category -> tests view with their order keys."""
    return valid_for_display(records).where(F.col("Test_Name") != "").select(
        SCOPE, F.coalesce("Test_Date", F.lit("Unknown")).alias("date"), client_day().alias("day"),
        F.coalesce(blank_to_null(F.col("Test_Category")), F.lit("Uncategorized")).alias("category"),
        "Test_Name", "Result", "Status", ORDER,
    )


def test_timeline(records: DataFrame) -> DataFrame:
    return valid_for_display(records, True).select(
        SCOPE, F.trim("Test_Name").alias("test_name"), F.coalesce("Test_Date", F.lit("Unknown")).alias("date"),
        client_day().alias("day"), F.col("Result").alias("value"),
        F.coalesce("Reference_Range", F.lit("N/A")).alias("reference_range"),
        F.coalesce("Status", F.lit("N/A")).alias("status"), F.coalesce("Unit", F.lit("")).alias("unit"),
        F.coalesce(blank_to_null(F.col("Test_Category")), F.lit("Uncategorized")).alias("category"), ORDER,
    )


def latest_in_timeline(timeline: DataFrame) -> DataFrame:
    """Last entry per test; an unknown date counts as latest, as does the later
    row of two on one day."""
    row = F.struct("date", "value", "status", "unit", "category", "reference_range")
    out = timeline.groupBy(SCOPE, "test_name").agg(
        n_rows().alias("readings"), F.max_by(row, F.struct("day", ORDER)).alias("r")
    )
    return out.select(SCOPE, "test_name", "readings", "r.*")


def latest_per_test(records: DataFrame) -> DataFrame:
    """Latest row per test by date, laboratory, row; unreadable dates win."""
    row = F.struct("Test_Date", "Lab_Name", "Result", "Unit", "Status", ORDER)
    lab = F.coalesce("Lab_Name", F.lit("Unknown Lab"))
    key = F.struct(_day(va.parse_date_day_first(F.col("Test_Date"))).alias("d"), lab.alias("l"), F.col(ORDER).alias("o"))
    return records.groupBy(SCOPE, "Test_Name").agg(F.max_by(row, key).alias("r")).select(SCOPE, "Test_Name", "r.*")


# --- per report -------------------------------------------------------------
def report_timeline(records: DataFrame, keep: int = 12, preview: int = 10) -> DataFrame:
    """Tests performed and abnormal preview per (date, laboratory); the first
    ``keep`` reports per scope in date order."""
    keys = [SCOPE, "date", "lab"]
    rows = records.select(
        SCOPE, F.coalesce("Test_Date", F.lit("Unknown date")).alias("date"),
        F.coalesce("Lab_Name", F.lit("Unknown Lab")).alias("lab"),
        _day(va.parse_date_day_first(F.col("Test_Date"))).alias("day"),
        "Test_Name", "Result", "Unit", "Status", ORDER,
    )
    reports = rows.groupBy(*keys, "day").agg(n_rows().alias("tests_performed"), F.min(F.struct("Test_Name", ORDER)).alias("_f"))
    kept = top_per_scope(reports, [F.asc("day"), F.asc("lab"), F.asc("_f")], keep)
    w = Window.partitionBy(*keys).orderBy("Test_Name", ORDER)
    abnormal = (
        rows.where(st.abnormal_chat(F.col("Status"))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= preview)
    )
    text = F.trim(F.concat(
        F.coalesce("Test_Name", F.lit("Unknown")), F.lit(": "), F.coalesce("Result", F.lit("N/A")), F.lit(" "),
        F.coalesce("Unit", F.lit("")), F.lit(" ("), F.coalesce("Status", F.lit("ABNORMAL")), F.lit(")"),
    ))
    previews = abnormal.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", text.alias("t")))), lambda s: s["t"]), ", ").alias("p")
    )
    return kept.join(previews, keys, "left").select(
        *keys, "rank", "tests_performed", F.coalesce("p", F.lit("None")).alias("abnormal_findings")
    )


def chat_findings(records: DataFrame) -> DataFrame:
    """Findings as a chat names them; the text work is done once per spelling of a name, a status or a date."""
    name = F.coalesce(blank_to_null(F.coalesce("Test_Name", "Original_Test_Name")), F.lit("Unknown test"))
    source = records.select(SCOPE, ORDER, name.alias("name"), "Test_Date", "Lab_Name", "Result", "Unit", "Status")
    key = F.col("_key")
    canonical = F.coalesce(F.nullif(nm.chat_key(key), F.lit("")), F.lower(key))
    named = with_derived(source, {"name": {"canonical": canonical}, "Status": {"severity": st.chat_severity(key)}})
    dated = with_derived(named, {"Test_Date": {"day": _day(va.parse_client_date(key))}})
    return dated.select(
        SCOPE, F.coalesce(blank_to_null(F.col("Test_Date")), F.lit("Unknown date")).alias("date"),
        F.coalesce(blank_to_null(F.col("Lab_Name")), F.lit("Unknown Lab")).alias("lab"), "name", "canonical",
        F.coalesce(blank_to_null(F.col("Result")), F.lit("N/A")).alias("value"),
        F.coalesce(blank_to_null(F.col("Unit")), F.lit("")).alias("unit"), "severity", "day", ORDER,
    )


def chat_reports(findings: DataFrame) -> DataFrame:
    return findings.groupBy(SCOPE, "date", "lab", "day").agg(n_rows().alias("tests"), F.min(ORDER).alias("_first"))


def last_reports(findings: DataFrame, keep: int = 12) -> DataFrame:
    return top_per_scope(chat_reports(findings), [F.desc("day"), F.desc("_first")], keep)


def persistent_concerns(findings: DataFrame, keep: int = 12) -> DataFrame:
    """Tests abnormal at least twice within the last reports.

    The last reports of a scope meet its findings as one short list: findings
    that lie by scope stay where they are."""
    at = F.struct("date", "lab")
    recent = last_reports(findings, keep).groupBy(SCOPE).agg(F.collect_list(at).alias("_recent"))
    return (
        findings.where("severity <> 'NORMAL'").join(recent, SCOPE).withColumn("_at", at)
        # a report that is listed under several days counts once for each
        .select(SCOPE, "canonical", F.size(F.filter("_recent", lambda r: r == F.col("_at"))).alias("_n"))
        .groupBy(SCOPE, "canonical").agg(F.sum("_n").alias("abnormal_reports")).where("abnormal_reports >= 2")
    )


def finding_line(name: Column, value: Column, unit: Column) -> Column:
    return F.concat(name, F.lit(": "), value, F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise(""))


def recent_timeline(findings: DataFrame, keep: int = 12, preview: int = 8, met: bool = False) -> DataFrame:
    """The last reports of a scope, oldest first (``place``), with the first
    findings of each that aren't normal.  ``met``: as for :func:`prompt_parts`."""
    keys = [SCOPE, "date", "lab"]
    findings = findings if met else by_scope(findings.select(*keys, "day", "name", "value", "unit", "severity", ORDER))
    kept = last_reports(findings, keep).withColumn("place", F.row_number().over(Window.partitionBy(SCOPE).orderBy("day", "_first")))
    w = Window.partitionBy(*keys).orderBy(ORDER)
    # findings and lines meet their reports by scope: those that lie by scope stay where they are
    at = F.struct("date", "lab")
    recent = kept.groupBy(SCOPE).agg(F.collect_set(at).alias("_recent"))
    listed = findings.where("severity <> 'NORMAL'").join(recent, SCOPE).where(F.array_contains("_recent", at)).drop("_recent")
    shown = listed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= preview)
    line = F.concat(finding_line(F.col("name"), F.col("value"), F.col("unit")), F.lit(" ("), F.col("severity"), F.lit(")"))
    lines = shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", line.alias("t")))), lambda s: s["t"]), ", ").alias("abnormal"))
    of_scope = lines.groupBy(SCOPE).agg(F.collect_list(F.struct("date", "lab", "abnormal")).alias("_lines"))
    own = F.filter("_lines", lambda x: (x["date"] == F.col("date")) & (x["lab"] == F.col("lab")))
    return kept.join(of_scope, SCOPE, "left").select(*keys, "place", "tests", F.coalesce(F.try_element_at(own, F.lit(1))["abnormal"], F.lit("None")).alias("abnormal"))


def by_scope(findings: DataFrame) -> DataFrame:
    """Findings written once, those of a scope together: what many aggregates read shuffles a finding once."""
    return materialize_by(findings, "findings-by-scope", SCOPE)


def prompt_parts(findings: DataFrame, keep: int = 12, preview: int = 8, values: int = 40, met: bool = False) -> DataFrame:
    """What a chat about a scope is told: its reports, lasting concerns and latest values, as lines.

    ``met``: the findings are from :func:`by_scope` already."""
    findings = findings if met else by_scope(findings)

    def joined(rows: DataFrame, order: list[Column], line: Column, name: str, sep: str) -> DataFrame:
        key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("t"))
        return rows.groupBy(SCOPE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["t"]), sep).alias(name))

    recent = recent_timeline(findings, keep, preview, met=True)
    told = F.concat(
        F.lit("Date: "), F.col("date"), F.lit(" | Lab: "), F.col("lab"), F.lit("\nTests performed: "), F.col("tests").cast("string"),
        F.lit("\nAbnormal findings: "), F.col("abnormal"),
    )
    reports = joined(recent, [F.col("place")], told, "timeline", "\n---\n")
    lasting = persistent_concerns(findings, keep)
    concern = F.concat(F.col("canonical"), F.lit(" (abnormal in "), F.col("abnormal_reports").cast("string"), F.lit(" reports)"))
    concerns = joined(lasting, [-F.col("abnormal_reports"), F.col("canonical")], concern, "persistent", "\n")
    latest = snapshot(findings, values)
    value = F.concat(finding_line(F.col("canonical"), F.col("latest_value"), F.col("unit")), F.lit(" ["), F.col("latest_status"), F.lit("] as of "), F.col("latest_date"))
    newest = joined(latest, [F.col("rank")], value, "latest_values", "\n")
    return date_range(findings).join(reports, SCOPE, "left").join(concerns, SCOPE, "left").join(newest, SCOPE, "left").withColumn("persistent", F.coalesce("persistent", F.lit("None")))


def date_range(findings: DataFrame) -> DataFrame:
    """Report count, laboratories and first / last dated report."""
    reports = chat_reports(findings)
    dated = F.col("day") < F.lit(FAR).cast("date")
    first = F.struct("day", "_first")
    early = F.min_by("date", F.when(dated, first))
    late = F.min_by("date", F.when(dated, F.struct((-F.unix_date("day")).alias("d"), F.col("_first"))))
    out = reports.groupBy(SCOPE).agg(
        n_rows().alias("reports"), early.alias("s"), late.alias("e"), F.min_by("date", "_first").alias("fs"),
        F.max_by("date", "_first").alias("fe"), F.array_join(F.array_sort(F.collect_set("lab")), ", ").alias("labs"),
    )
    return out.select(SCOPE, "reports", "labs", F.coalesce("s", "fs").alias("start"), F.coalesce("e", "fe").alias("end"))


def latest_by_canonical(findings: DataFrame) -> DataFrame:
    """Latest finding per canonical name; the later row wins on one day."""
    row = F.struct("value", "unit", F.col("severity").alias("latest_status"), F.col("date").alias("latest_date"))
    out = findings.groupBy(SCOPE, "canonical").agg(
        F.max_by(row, F.struct("day", ORDER)).alias("r"), F.max("day").alias("day"), F.min(ORDER).alias("_first")
    )
    return out.select(SCOPE, "canonical", "day", "_first", F.col("r.value").alias("latest_value"), "r.unit", "r.latest_status", "r.latest_date")


def snapshot(findings: DataFrame, k: int = 40, abnormal_only: bool = False) -> DataFrame:
    """Newest latest-values first, at most k per scope."""
    rows = latest_by_canonical(findings)
    if abnormal_only:
        rows = rows.where("latest_status <> 'NORMAL'")
    return top_per_scope(rows, [F.desc("day"), F.asc("_first")], k).drop("_first")


def fallback_findings(findings: DataFrame) -> DataFrame:
    """The five latest findings that are not normal, as printed lines."""
    top = snapshot(findings, 5, True)
    shown = F.when(F.col("unit") != "", F.concat_ws(" ", "latest_value", "unit")).otherwise(F.col("latest_value"))
    line = F.concat(F.lit("- "), F.col("canonical"), F.lit(": **"), shown, F.lit("** ("), F.col("latest_status"), F.lit(") on "), F.col("latest_date"))
    return top.select(SCOPE, "rank", line.alias("line"))


# --- per source file --------------------------------------------------------
def file_trend(files: DataFrame, records: DataFrame) -> DataFrame:
    """Counts per listed file, zero when no record names it."""
    key = tx.file_key(F.col("Source_Filename"))
    counts = records.groupBy(key.alias("_k")).agg(
        n_rows().alias("t"), F.count_if(st.abnormal_dash(F.col("Status"))).alias("c"), F.count_if(st.good(F.col("Status"))).alias("g")
    )
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return files.withColumn("_k", tx.file_key(F.col("file_name"))).join(counts, "_k", "left").select(
        "file_name", zero("t", "total"), zero("c", "concerning"), zero("g", "good")
    )
