"""Scores, body systems, alerts, organized tables, panel findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.catalog import duck as d
from labtrail.catalog.records import normalized, resolved
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, sql_text
from labtrail.functions import values as va
from labtrail.operators import insights as ins
from labtrail.operators import panel as pan

CLEAN_LABS = ["City Lab", "Apollo Diagnostics", "Metro", "Unknown Lab", "Sunrise Pathology", "Care", "LabOne"]
YEAR_LABS = [f"{y}_{lab}" for y in range(1995, 2002) for lab in CLEAN_LABS]
DATE_LAB = f"""coalesce("Test_Date", 'Unknown Date') || '_' || {d.clean_lab('"Lab_Name"')}"""


def yearly(spark, sf):
    """Records dated by year only, so a wide table has a bounded column list."""
    return lab_records(spark, sf).withColumn("Test_Date", F.substring_index("study_id", "-", -1))


SQL.add("yearly", """SELECT * REPLACE (string_split(study_id, '-')[2] AS "Test_Date") FROM lab_records""", "lab_records")
SQL.add("lab_map", f'SELECT "Lab_Name" AS lab, {d.clean_lab(chr(34) + "Lab_Name" + chr(34))} AS clean FROM (SELECT DISTINCT "Lab_Name" FROM lab_records)', "lab_records")


def cells_views(name, source):
    SQL.add(f"{name}_base", f"""SELECT r.*, coalesce("Test_Date", 'Unknown Date') || '_' || m.clean AS date_lab FROM {source} r JOIN lab_map m ON m.lab = r."Lab_Name"
      WHERE "Test_Name" <> 'N/A' AND "Result" IS NOT NULL AND "Test_Category" IS NOT NULL""", source, "lab_map")
    SQL.add(name, f"""SELECT scope_id, "Test_Category", "Test_Name", date_lab, arg_min("Result", row_ord) AS "Result" FROM {name}_base GROUP BY ALL""", f"{name}_base")
    SQL.add(f"{name}_ref", f"""SELECT scope_id, "Test_Category", "Test_Name", date_lab, arg_min("Reference_Range", row_ord) AS "Reference_Range" FROM {name}_base
      WHERE "Reference_Range" IS NOT NULL GROUP BY ALL""", f"{name}_base")


cells_views("cells", "lab_records")
cells_views("ycells", "yearly")
CELL_DAY = f"coalesce({d.date_day_first(chr(115))}, DATE '0001-01-01')"
SQL.add("cells_dated", f"SELECT c.*, ROW({CELL_DAY}, date_lab) AS o FROM (SELECT *, string_split(date_lab, '_')[1] AS s FROM cells) c", "cells")
SQL.add("cells_ref_dated", f"""SELECT c.*, ROW({CELL_DAY}, date_lab) AS o FROM (SELECT *, string_split(date_lab, '_')[1] AS s FROM cells_ref WHERE trim("Reference_Range") <> '' AND "Reference_Range" <> 'N/A') c""", "cells_ref")


def wide_sql(view, value):
    cols = ", ".join(f"min({value}) FILTER (WHERE date_lab = {sql_text(c)}) AS \"{c}\"" for c in YEAR_LABS)
    return f'SELECT scope_id, "Test_Category", "Test_Name", {cols} FROM {view} GROUP BY ALL'


SQL.add("entries", f"""SELECT r.scope_id, r.row_ord, n.name AS test_name, c.category, r."Result" AS value_text, {d.leading_numeric('r."Result"')} AS value,
  {d.client_low('r."Reference_Range"')} AS low, {d.client_high('r."Reference_Range"')} AS high, {d.client_status('r."Status"')} AS status,
  {d.severity3('r."Status"')} AS severity, coalesce(r."Test_Date", 'Unknown') AS report_date, coalesce({d.client_date('r."Test_Date"')}, DATE '0001-01-01') AS day
  FROM lab_records r JOIN client_names n ON n.raw = {d.strip('r."Test_Name"')} JOIN cat_map c ON c.raw IS NOT DISTINCT FROM r."Test_Category"
  WHERE n.name <> 'Unknown Test'""", "lab_records", "client_names", "cat_map")
SQL.add("entries_dev", f"SELECT *, {d.deviation('value', 'low', 'high', 'severity')} AS deviation, CASE severity WHEN 'HIGH' THEN 3 WHEN 'BORDERLINE' THEN 2 ELSE 1 END AS sr FROM entries", "entries")
SQL.add("streaks", """SELECT scope_id, test_name, count(*) AS streak FROM (SELECT *, sum(CASE WHEN severity = 'NORMAL' THEN 1 ELSE 0 END)
  OVER (PARTITION BY scope_id, test_name ORDER BY day DESC, row_ord ROWS UNBOUNDED PRECEDING) AS stops FROM entries) WHERE stops = 0 GROUP BY ALL""", "entries")
SQL.add("deviant", "SELECT * FROM entries_dev QUALIFY row_number() OVER (PARTITION BY scope_id, test_name ORDER BY deviation DESC, sr DESC, row_ord) = 1", "entries_dev")
SQL.add("newest", "SELECT *, row_number() OVER (PARTITION BY scope_id, test_name ORDER BY day DESC, row_ord) AS rn FROM entries", "entries")
SQL.add("findings", """SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, first_ord) AS rank FROM (
  SELECT w.scope_id, w.test_name, w.value_text AS worst_value, w.severity, w.status, w.report_date AS worst_date, l.value_text AS latest_value,
  l.report_date AS latest_date, l.severity AS latest_severity, g.total_reports, g.abnormal_count, coalesce(s.streak, 0) AS streak, g.first_ord,
  CASE w.severity WHEN 'HIGH' THEN 100 WHEN 'BORDERLINE' THEN 50 ELSE 10 END + coalesce(s.streak, 0) * 25 + w.deviation AS score
  FROM deviant w JOIN newest l ON l.scope_id = w.scope_id AND l.test_name = w.test_name AND l.rn = 1
  JOIN (SELECT scope_id, test_name, count(*) AS total_reports, count(*) FILTER (WHERE severity <> 'NORMAL') AS abnormal_count, min(row_ord) AS first_ord FROM entries GROUP BY ALL) g
    ON g.scope_id = w.scope_id AND g.test_name = w.test_name
  LEFT JOIN streaks s ON s.scope_id = w.scope_id AND s.test_name = w.test_name WHERE g.abnormal_count > 0) QUALIFY rank <= 8""", "deviant", "newest", "streaks", "entries")
THR = ("CASE WHEN abs(l.high - l.low) > 0 THEN abs(l.high - l.low) * 0.05 WHEN l.high IS NOT NULL AND l.high <> 0 THEN abs(l.high) * 0.05 "
       "WHEN l.low IS NOT NULL AND l.low <> 0 THEN abs(l.low) * 0.05 ELSE greatest(abs(p.value) * 0.05, 0.5) END")
SQL.add("two", f"""SELECT scope_id, test_name, latest_value, latest_date, latest_status, latest_severity, trend_delta, lower_is_better,
  CASE WHEN trend_delta IS NULL THEN 'insufficient_data' WHEN abs(trend_delta) <= lim THEN 'stable' WHEN lower_is_better = (trend_delta < 0) THEN 'improving' ELSE 'worsening' END AS trend
  FROM (SELECT l.scope_id, l.test_name, l.value_text AS latest_value, l.report_date AS latest_date, l.status AS latest_status, l.severity AS latest_severity,
  round(l.value - p.value, 2) AS trend_delta, {d.lower_better('l.test_name')} AS lower_is_better, {THR} AS lim FROM newest l
  LEFT JOIN newest p ON p.scope_id = l.scope_id AND p.test_name = l.test_name AND p.rn = 2 WHERE l.rn = 1)""", "newest")
SQL.add("prio_metrics", """SELECT t.*, g.report_count, row_number() OVER (PARTITION BY t.scope_id ORDER BY (t.latest_severity <> 'NORMAL') DESC, (t.trend = 'worsening') DESC, g.report_count DESC, g.first_ord) AS rank
  FROM two t JOIN (SELECT scope_id, test_name, count(*) AS report_count, min(row_ord) AS first_ord FROM entries GROUP BY ALL) g ON g.scope_id = t.scope_id AND g.test_name = t.test_name
  QUALIFY rank <= 6""", "two", "entries")


def entries(s, f):
    return pan.finding_entries(lab_records(s, f))


def register() -> None:
    L, NZ = "lab_records", "normalized"
    query("e01_overall_score", f"""SELECT scope_id, CAST(floor(sum({d.weight('"Status"', 0)}) / count(*)) AS BIGINT) AS overall_score, count(*) AS total_tests FROM normalized GROUP BY 1""", NZ)(
        lambda s, f: ins.overall_score(normalized(s, f)))
    cats = f"""SELECT scope_id, "Test_Category", CAST(floor(sum({d.weight('"Status"', 70)}) / count(*)) AS BIGINT) AS score, count(*) AS total_tests,
      count(*) FILTER (WHERE {d.ABN_SCORE('"Status"')}) AS abnormal_count FROM {{}} WHERE "Test_Category" IS NOT NULL AND "Test_Category" <> 'N/A' GROUP BY ALL"""
    SQL.add("resolved_scores", cats.format("resolved"), "resolved")
    SQL.add("scores", cats.format("normalized"), NZ)
    query("e02_category_scores", "SELECT * FROM resolved_scores", "resolved_scores")(lambda s, f: ins.category_scores(resolved(s, f)))
    conc = f"""SELECT scope_id, row_ord, "Test_Name" AS test_name, "Result" AS result, "Status" AS status, "Reference_Range" AS reference, "Test_Category" AS category, "Test_Date" AS date
      FROM normalized WHERE {d.ABN_SCORE('"Status"')}"""
    SQL.add("concerns", conc, NZ)
    query("e03_concerns", "SELECT * FROM concerns", "concerns")(lambda s, f: ins.concerns(normalized(s, f)))
    from labtrail import fixed_values as fv

    emo = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in fv.BODY_PART_SYMBOL.items())
    SQL.add("systems", f"""SELECT *, CASE system {emo} ELSE {sql_text(fv.DEFAULT_SYMBOL)} END AS emoji, abnormal_count / total_count AS abnormal_ratio,
      CASE WHEN abnormal_count / total_count >= 0.5 THEN 'flagged' ELSE 'normal' END AS concern_level, CASE WHEN abnormal_count / total_count >= 0.5 THEN 2 ELSE 1 END AS concern_score
      FROM (SELECT s.scope_id, coalesce(b.part, 'General') AS system, CAST(sum(s.abnormal_count) AS BIGINT) AS abnormal_count, CAST(sum(s.total_tests) AS BIGINT) AS total_count,
      string_agg(DISTINCT s."Test_Category", '|' ORDER BY s."Test_Category") AS categories FROM scores s LEFT JOIN body_t b ON b.category = s."Test_Category" GROUP BY 1, 2)""", "scores", "body_t")
    query("e04_body_systems", "SELECT *, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY concern_score DESC, abnormal_count DESC, system) AS INTEGER) AS place FROM systems", "systems")(lambda s, f: ins.most_concerning_first(ins.body_systems(normalized(s, f))))
    SQL.add("migr", f"""SELECT scope_id, coalesce({d.nz('"Test_Category"')}, 'Other') AS "Test_Category", CAST(greatest(0, floor((count(*) - count(*) FILTER (WHERE {d.ABN_MIGR('"Status"')})) / count(*) * 100 + 0.5)) AS BIGINT) AS score,
      count(*) AS total_tests, count(*) FILTER (WHERE {d.ABN_MIGR('"Status"')}) AS abnormal_count FROM normalized GROUP BY 1, 2""", NZ)
    query("e05_migration_summary", """SELECT m.*, o.overall_score FROM migr m JOIN (SELECT scope_id, CAST(floor(sum(score) / count(*) + 0.5) AS BIGINT) AS overall_score FROM migr GROUP BY 1) o USING (scope_id)""", "migr")(
        lambda s, f: (lambda r: ins.migration_category_scores(r).join(ins.migration_overall(r), "scope_id"))(normalized(s, f)))
    SQL.add("alerts", """SELECT *, CASE WHEN critical_count > 0 THEN 'critical' WHEN high_count > 0 THEN 'high' WHEN low_count > 0 THEN 'low' ELSE 'normal' END AS severity FROM (
      SELECT scope_id, coalesce(nullif(trim(category), ''), 'Uncategorized') AS category, count(*) AS total_alerts, count(*) FILTER (WHERE lower(status) = 'critical') AS critical_count,
      count(*) FILTER (WHERE lower(status) IN ('high', 'positive', 'flagged')) AS high_count, count(*) FILTER (WHERE lower(status) = 'low') AS low_count,
      count(*) FILTER (WHERE lower(status) NOT IN ('critical', 'high', 'positive', 'flagged', 'low')) AS normal_count FROM concerns GROUP BY 1, 2)""", "concerns")
    query("e06_alerts_by_category", "SELECT *, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY list_position(['critical', 'high', 'low', 'normal'], severity), total_alerts DESC, category) AS INTEGER) AS place FROM alerts", "alerts")(lambda s, f: ins.most_severe_first(ins.alerts_by_category(ins.concerns(normalized(s, f)))))
    SQL.add("atrend", f"""SELECT scope_id, coalesce({d.nz('"Test_Date"')}, 'Unknown') AS date, count(*) FILTER (WHERE {d.ABN_PANEL('"Status"')}) AS alert_count, count(*) AS total_count FROM lab_records GROUP BY 1, 2""", L)
    query("e09_alert_trend", "SELECT * FROM atrend", "atrend")(lambda s, f: ins.alert_trend(lab_records(s, f)))
    query("e10_category_comparison", f"""SELECT scope_id, "Test_Category" AS category, count(*) AS alerts FROM normalized WHERE {d.ABN_PANEL('"Status"')} GROUP BY ALL""", NZ)(
        lambda s, f: ins.category_comparison(normalized(s, f)))
    query("e11_trend_by_date", f"""SELECT scope_id, coalesce("Test_Date", 'Unknown') AS date, count(*) AS total, count(*) FILTER (WHERE {d.ABN_DASH('"Status"')}) AS concerning,
      count(*) FILTER (WHERE {d.GOOD('"Status"')}) AS good, CAST(floor(count(*) FILTER (WHERE {d.ABN_DASH('"Status"')}) / count(*) * 100 + 0.5) AS BIGINT) AS concerning_percent FROM lab_records GROUP BY 1, 2""", L)(
        lambda s, f: ins.trend_by_date(lab_records(s, f)))
    query("e27_counters", f"""SELECT *, CASE WHEN critical > 0 THEN 'Attention Required' WHEN alert_rate >= 30 THEN 'Monitor Closely' ELSE 'Generally Stable' END AS clinical_state FROM (
      SELECT scope_id, count(*) AS records, count(*) FILTER (WHERE {d.GOOD('"Status"')}) AS normal, count(*) FILTER (WHERE {d.ABN_DASH('"Status"')}) AS concerning,
      count(*) FILTER (WHERE lower("Status") = 'critical') AS critical, count(*) FILTER (WHERE {d.ABN_PANEL('"Status"')}) AS alerts, count(DISTINCT trim("Source_Filename")) AS sources,
      CAST(floor(count(*) FILTER (WHERE {d.ABN_PANEL('"Status"')}) / count(*) * 100 + 0.5) AS BIGINT) AS alert_rate FROM lab_records GROUP BY 1)""", L)(
        lambda s, f: ins.counters(lab_records(s, f)))
    query("e28_trend_narrative", f"""SELECT scope_id, dates, first_alerts, last_alerts, abs(CAST(CASE WHEN first_alerts = 0 THEN (CASE WHEN last_alerts > 0 THEN 100 ELSE 0 END)
      ELSE floor((last_alerts - first_alerts) / first_alerts * 100 + 0.5) END AS BIGINT)) AS percent_change,
      CASE WHEN dates = 1 THEN 'single date' WHEN last_alerts = first_alerts THEN 'stable' WHEN last_alerts > first_alerts THEN 'increasing' ELSE 'decreasing' END AS direction FROM (
      SELECT scope_id, count(*) AS dates, arg_min(alert_count, ROW(dy, date)) AS first_alerts, arg_max(alert_count, ROW(dy, date)) AS last_alerts FROM
      (SELECT *, coalesce({d.client_date('date')}, DATE '9999-12-31') AS dy FROM atrend) GROUP BY 1)""", "atrend")(
        lambda s, f: ins.trend_narrative(ins.alert_trend(lab_records(s, f))))
    query("e45_score_band", f"""SELECT o.scope_id, overall_score, CASE WHEN overall_score >= 80 THEN 'Good' WHEN overall_score >= 60 THEN 'Fair' ELSE 'Needs Review' END AS band,
      coalesce(fl, 0) AS flagged_systems, coalesce(no, 0) AS normal_systems FROM (SELECT scope_id, CAST(floor(sum({d.weight('"Status"', 0)}) / count(*)) AS BIGINT) AS overall_score FROM normalized GROUP BY 1) o
      LEFT JOIN (SELECT scope_id, count(*) FILTER (WHERE concern_level = 'flagged') AS fl, count(*) FILTER (WHERE concern_level = 'normal') AS no FROM systems GROUP BY 1) y USING (scope_id)""", NZ, "systems")(
        lambda s, f: (lambda r: ins.score_band(ins.overall_score(r), ins.body_systems(r)))(normalized(s, f)))
    query("e46_first_concerns", "SELECT *, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY row_ord) AS INTEGER) AS place FROM concerns QUALIFY place <= 8", "concerns")(
        lambda s, f: ins.first_concerns(ins.concerns(normalized(s, f))))
    query("e46_critical_total", """SELECT a.scope_id, CAST(sum(critical_count) AS BIGINT) AS critical_total, any_value(r.n) AS report_count FROM alerts a
      JOIN (SELECT scope_id, greatest(1, count(DISTINCT "Source_Filename")) AS n FROM lab_records GROUP BY 1) r ON r.scope_id = a.scope_id GROUP BY 1""", "alerts", L)(
        lambda s, f: ins.critical_total(ins.alerts_by_category(ins.concerns(normalized(s, f)))).join(ins.distinct_reports(lab_records(s, f)), "scope_id"))

    # organized tables
    query("e20_organized_cells", "SELECT * FROM cells", "cells")(lambda s, f: ins.organized_cells(lab_records(s, f)))
    query("s03_column_order", "SELECT scope_id, date_lab, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY o) AS INTEGER) AS place FROM (SELECT DISTINCT scope_id, date_lab, o FROM cells_dated)", "cells_dated")(
        lambda s, f: ins.column_ranks(ins.organized_cells(lab_records(s, f))))
    query("e20_organized_pivot", wide_sql("ycells", '"Result"'), "ycells")(
        lambda s, f: ins.organized_table(ins.organized_cells(yearly(s, f)), YEAR_LABS))
    dates, labs = (", ".join(f"'{c.split('_')[k]}' AS \"{c}\"" for c in YEAR_LABS) for k in (0, 1))
    query("s11_header_rows", f"""SELECT scope_id, CAST(2 AS INTEGER) AS place, * EXCLUDE (scope_id) FROM ({wide_sql("ycells", '"Result"')})
      UNION ALL SELECT DISTINCT scope_id, 0, '📅 Date' AS "Test_Category", '' AS "Test_Name", {dates} FROM ycells
      UNION ALL SELECT DISTINCT scope_id, 1, '🏥 Lab', '', {labs} FROM ycells""", "ycells")(
        lambda s, f: ins.with_header_rows(ins.organized_table(ins.organized_cells(yearly(s, f)), YEAR_LABS), YEAR_LABS))
    query("e21_range_pivot", wide_sql("ycells_ref", '"Reference_Range"'), "ycells_ref")(
        lambda s, f: ins.organized_table(ins.organized_cells(yearly(s, f), value="Reference_Range"), YEAR_LABS, value="Reference_Range"))
    common = """SELECT scope_id, "Test_Category", "Test_Name", arg_min("Reference_Range", ROW(-n, o)) AS "Reference_Range" FROM (SELECT scope_id, "Test_Category", "Test_Name", "Reference_Range",
      count(*) AS n, min(o) AS o FROM cells_ref_dated GROUP BY ALL) GROUP BY ALL"""
    SQL.add("common_ref", common, "cells_ref_dated")
    query("e22_common_range", "SELECT * FROM common_ref", "common_ref")(lambda s, f: ins.common_ranges(lab_records(s, f)))
    query("j16_range_lookup", """SELECT c.*, r."Reference_Range" FROM cells c LEFT JOIN common_ref r USING (scope_id, "Test_Category", "Test_Name")""", "cells", "common_ref")(
        lambda s, f: ins.organized_cells(lab_records(s, f)).join(ins.common_ranges(lab_records(s, f)), ["scope_id", "Test_Category", "Test_Name"], "left"))
    num = d.strict_numeric('"Result"')
    query("e23_workbook_summary", f"""SELECT a.scope_id, categories, tests, charts, date_labs, first_date, last_date, labs FROM
      (SELECT scope_id, count(DISTINCT "Test_Category") AS categories, count(*) AS tests, count(*) FILTER (WHERE p > 1) AS charts FROM
        (SELECT scope_id, "Test_Category", "Test_Name", count({num}) AS p FROM cells GROUP BY ALL) GROUP BY 1) a
      JOIN (SELECT scope_id, count(DISTINCT date_lab) AS date_labs, string_split(arg_min(date_lab, o), '_')[1] AS first_date, string_split(arg_max(date_lab, o), '_')[1] AS last_date,
        string_agg(DISTINCT string_split(date_lab, '_')[2], '|' ORDER BY string_split(date_lab, '_')[2]) AS labs FROM cells_dated GROUP BY 1) b USING (scope_id)""", "cells", "cells_dated")(
        lambda s, f: ins.workbook_summary(lab_records(s, f)))
    query("e23_tests_per_category", """SELECT scope_id, "Test_Category", count(DISTINCT "Test_Name") AS tests FROM cells GROUP BY ALL""", "cells")(
        lambda s, f: ins.tests_per_category(lab_records(s, f)))
    series = f"""SELECT p.*, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max FROM (
      SELECT c.scope_id, c."Test_Category", c."Test_Name", c.date_lab, {num} AS value, x.low, x.high,
      CASE WHEN wd > 0 THEN b - wd * 0.15 ELSE b * 0.85 END AS y_min, CASE WHEN wd > 0 THEN t + wd * 0.15 ELSE t * 1.15 END AS y_max FROM cells c JOIN
      (SELECT *, CASE WHEN b <> t THEN t - b ELSE t * 0.1 END AS wd FROM (SELECT g.*, {d.range_low('ref')} AS low, {d.range_high('ref')} AS high, least(lo, {d.range_low('ref')}, {d.range_high('ref')}) AS b,
        greatest(hi, {d.range_low('ref')}, {d.range_high('ref')}) AS t FROM (SELECT scope_id, "Test_Category", "Test_Name", count(*) AS n, min({num}) AS lo, max({num}) AS hi FROM cells WHERE {num} IS NOT NULL GROUP BY ALL HAVING count(*) > 1) g
        LEFT JOIN (SELECT scope_id, "Test_Category", "Test_Name", arg_min("Reference_Range", o) AS ref FROM cells_ref_dated GROUP BY ALL) r USING (scope_id, "Test_Category", "Test_Name"))) x
      USING (scope_id, "Test_Category", "Test_Name") WHERE {num} IS NOT NULL) p"""
    series = series.replace("SELECT p.*, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max FROM", 'SELECT p.* REPLACE (round(y_min, 6) AS y_min, round(y_max, 6) AS y_max) FROM')
    rnd = lambda df, *cs: df.select(*[F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns])
    query("e42_chart_series", series, "cells", "cells_ref_dated")(lambda s, f: rnd(ins.chart_series(lab_records(s, f)), "y_min", "y_max"))
    SQL.add("latest_ref", f"""SELECT scope_id, "Test_Name", arg_max("Reference_Range", ROW(dy IS NULL, coalesce(dy, DATE '0001-01-01'), row_ord)) AS ref, min(v) AS lo, max(v) AS hi FROM
      (SELECT *, {num} AS v, {d.date_day_first('"Test_Date"')} AS dy FROM lab_records WHERE {num} IS NOT NULL) GROUP BY ALL""", L)
    SQL.add("latest_lim", f"SELECT *, {d.range_low('ref')} AS low, {d.range_high('ref')} AS high, {d.range_kind('ref')} AS kind FROM latest_ref", "latest_ref")
    ok = "(kind = 'range' AND (low + high) / 2 <> 0)"
    query("m14_normalized_value", f"""SELECT r.scope_id, r."Test_Name", r.row_ord, {d.strict_numeric('r."Result"')} AS value, round(CASE WHEN {ok} THEN {d.strict_numeric('r."Result"')} / ((low + high) / 2) * 100 ELSE {d.strict_numeric('r."Result"')} END, 6) AS normalized,
      round(CASE WHEN {ok} THEN low / ((low + high) / 2) * 100 END, 6) AS low_limit, round(CASE WHEN {ok} THEN high / ((low + high) / 2) * 100 END, 6) AS high_limit
      FROM lab_records r JOIN latest_lim l ON l.scope_id = r.scope_id AND l."Test_Name" = r."Test_Name" WHERE {d.strict_numeric('r."Result"')} IS NOT NULL""", L, "latest_lim")(
        lambda s, f: rnd(ins.normalized_values(lab_records(s, f)), "normalized", "low_limit", "high_limit"))
    pad = lambda alt, sh="0.1": f"abs(CASE WHEN hi - lo > 0 THEN (hi - lo) * {sh} ELSE {alt} * {sh} END)"
    query("m15_plot_axis", f"""SELECT scope_id, "Test_Name", kind, round(CASE kind WHEN 'range' THEN least(lo, low) - {pad('low')} WHEN 'less_than' THEN least(lo, 0) - {pad('lo')}
      WHEN 'greater_than' THEN least(lo, low) - {pad('low')} ELSE lo - {pad('hi', '0.15')} END, 6) AS y_min, round(CASE kind WHEN 'range' THEN greatest(hi, high) + {pad('high')}
      WHEN 'less_than' THEN greatest(hi, high) + {pad('high')} WHEN 'greater_than' THEN greatest(hi, hi * 1.2) + {pad('hi')} ELSE hi + {pad('hi', '0.15')} END, 6) AS y_max FROM latest_lim""", "latest_lim")(
        lambda s, f: rnd(ins.plot_axis(lab_records(s, f)), "y_min", "y_max"))

    def gauges(s, f):
        r = lab_records(s, f).select("row_ord", va.strict_numeric(F.col("Result")).alias("v"), va.reference_range(F.col("Reference_Range")).alias("r")).where("v IS NOT NULL")
        lo, hi = ins.gauge_axis(F.col("v"), F.col("r"))
        return r.select("row_ord", F.round(lo, 6).alias("axis_min"), F.round(hi, 6).alias("axis_max"))

    query("m15_gauge_axis", f"""SELECT row_ord, round(CASE kind WHEN 'range' THEN least(low - (high - low) * 0.2, v - (high - low) * 0.2) WHEN 'less_than' THEN 0.0 WHEN 'greater_than' THEN least(low * 0.5, v * 0.8)
      ELSE v - CASE WHEN v <> 0 THEN abs(v * 0.5) ELSE 10 END END, 6) AS axis_min, round(CASE kind WHEN 'range' THEN greatest(high + (high - low) * 0.2, v + (high - low) * 0.2)
      WHEN 'less_than' THEN greatest(high * 1.5, v * 1.2) WHEN 'greater_than' THEN greatest(low * 1.5, v * 1.2) ELSE v + CASE WHEN v <> 0 THEN abs(v * 0.5) ELSE 10 END END, 6) AS axis_max
      FROM (SELECT row_ord, {num} AS v, {d.range_kind('"Reference_Range"')} AS kind, {d.range_low('"Reference_Range"')} AS low, {d.range_high('"Reference_Range"')} AS high FROM lab_records) WHERE v IS NOT NULL""", L)(gauges)

    # panel
    fcols = "scope_id, test_name, worst_value, severity, status, worst_date, latest_value, latest_date, latest_severity, total_reports, abnormal_count, streak, score, CAST(rank AS INTEGER) AS rank"
    query("e29_priority_findings", f"SELECT {fcols} FROM findings", "findings")(lambda s, f: pan.priority_findings(entries(s, f)))
    mcols = "scope_id, test_name, latest_value, latest_date, latest_status, latest_severity, trend_delta, trend, lower_is_better, report_count, CAST(rank AS INTEGER) AS rank"
    query("e30_priority_metrics", f"SELECT {mcols} FROM prio_metrics", "prio_metrics")(lambda s, f: pan.priority_metrics(entries(s, f)))
    query("w03_abnormal_streak", "SELECT scope_id, test_name, streak FROM streaks", "streaks")(lambda s, f: pan.abnormal_streaks(entries(s, f)))
    query("w04_previous_reading", "SELECT scope_id, test_name, latest_value, latest_date, latest_status, latest_severity, trend_delta, trend, lower_is_better FROM two", "two")(lambda s, f: pan.latest_two(entries(s, f)))
    query("w05_most_deviant", "SELECT scope_id, test_name, row_ord, deviation, severity FROM deviant", "deviant")(lambda s, f: pan.most_deviant(entries(s, f)).select("scope_id", "test_name", "row_ord", "deviation", "severity"))
    query("e31_structured_review", """SELECT t.*, coalesce(w.c, 'No category alerts') AS most_affected_category, coalesce(fs.s, false) AS has_streak, coalesce(ms.t, false) AS has_worsening FROM
      (SELECT scope_id, count(*) AS records, count(*) FILTER (WHERE severity <> 'NORMAL') AS total_alerts, count(DISTINCT report_date) AS report_dates FROM entries GROUP BY 1) t
      LEFT JOIN (SELECT scope_id, arg_min(category, ROW(-n, o)) AS c FROM (SELECT scope_id, category, count(*) AS n, min(row_ord) AS o FROM entries WHERE severity <> 'NORMAL' GROUP BY 1, 2) GROUP BY 1) w USING (scope_id)
      LEFT JOIN (SELECT scope_id, bool_or(streak >= 2) AS s FROM findings GROUP BY 1) fs USING (scope_id) LEFT JOIN (SELECT scope_id, bool_or(trend = 'worsening') AS t FROM prio_metrics GROUP BY 1) ms USING (scope_id)""",
      "entries", "findings", "prio_metrics")(lambda s, f: pan.structured_review(entries(s, f)).drop("recommendations"))
