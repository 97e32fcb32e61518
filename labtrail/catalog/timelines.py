"""Timelines, latest values, chat context."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.catalog import duck as d
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records
from labtrail.operators import timelines as tl

FAR = "DATE '9999-12-31'"
CD = d.client_date('"Test_Date"')
CK = d.chat_key('"Test_Name"')
SQL.add("chatf", f"""SELECT scope_id, row_ord, coalesce({d.nz('"Test_Date"')}, 'Unknown date') AS date, coalesce({d.nz('"Lab_Name"')}, 'Unknown Lab') AS lab, {d.strip('"Test_Name"')} AS name,
  coalesce(nullif({CK}, ''), lower("Test_Name")) AS canonical, coalesce({d.nz('"Result"')}, 'N/A') AS value, coalesce({d.nz('"Unit"')}, '') AS unit,
  {d.chat_severity('"Status"')} AS severity, coalesce({CD}, {FAR}) AS day FROM lab_records""", "lab_records")
SQL.add("chatr", "SELECT scope_id, date, lab, day, count(*) AS tests, min(row_ord) AS first_ord FROM chatf GROUP BY ALL", "chatf")
SQL.add("lastr", "SELECT * FROM chatr QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY day DESC, first_ord DESC) <= 12", "chatr")
SQL.add("persist", """SELECT f.scope_id, f.canonical, count(*) AS abnormal_reports FROM chatf f JOIN lastr r ON r.scope_id = f.scope_id AND r.date = f.date AND r.lab = f.lab
  WHERE severity <> 'NORMAL' GROUP BY ALL HAVING count(*) >= 2""", "chatf", "lastr")
SQL.add("latestc", """SELECT scope_id, canonical, max(day) AS day, min(row_ord) AS first_ord, arg_max(value, ROW(day, row_ord)) AS latest_value, arg_max(unit, ROW(day, row_ord)) AS unit,
  arg_max(severity, ROW(day, row_ord)) AS latest_status, arg_max(date, ROW(day, row_ord)) AS latest_date FROM chatf GROUP BY ALL""", "chatf")
SQL.add("drange", f"""SELECT scope_id, count(*) AS reports, string_agg(DISTINCT lab, ', ' ORDER BY lab) AS labs,
  coalesce(arg_min(date, ROW(day, first_ord)) FILTER (WHERE day < {FAR}), arg_min(date, first_ord)) AS start,
  coalesce(arg_min(date, ROW(-date_diff('day', DATE '1970-01-01', day), first_ord)) FILTER (WHERE day < {FAR}), arg_max(date, first_ord)) AS "end" FROM chatr GROUP BY 1""", "chatr")


def chatf(s, f):
    return tl.chat_findings(lab_records(s, f))


def files(s, f):
    from labtrail.catalog.records import report_files

    return report_files(s, f).select("file_name")


def register() -> None:
    L = "lab_records"
    query("e07_date_category_groups", f"""SELECT scope_id, coalesce("Test_Date", 'Unknown') AS date, coalesce({CD}, {FAR}) AS day, coalesce({d.nz('"Test_Category"')}, 'Uncategorized') AS category,
      "Test_Name", "Result", "Status", row_ord FROM lab_records WHERE "Test_Name" NOT IN ('N/A', '') AND "Result" IS NOT NULL""", L)(lambda s, f: tl.by_date_and_category(lab_records(s, f)))
    tlv = f"""SELECT scope_id, trim("Test_Name") AS test_name, coalesce("Test_Date", 'Unknown') AS date, coalesce({CD}, {FAR}) AS day, "Result" AS value, coalesce("Reference_Range", 'N/A') AS reference_range,
      coalesce("Status", 'N/A') AS status, coalesce("Unit", '') AS unit, coalesce({d.nz('"Test_Category"')}, 'Uncategorized') AS category, row_ord FROM lab_records
      WHERE "Test_Name" <> 'N/A' AND trim("Test_Name") <> '' AND trim("Result") <> ''"""
    SQL.add("tline", tlv, L)
    query("e08_test_timeline", "SELECT * FROM tline", "tline")(lambda s, f: tl.test_timeline(lab_records(s, f)))
    query("e08_latest_entry", """SELECT scope_id, test_name, readings, date, value, status, unit, category, reference_range FROM (SELECT *, count(*) OVER (PARTITION BY scope_id, test_name) AS readings
      FROM tline QUALIFY row_number() OVER (PARTITION BY scope_id, test_name ORDER BY day DESC, row_ord DESC) = 1)""", "tline")(lambda s, f: tl.latest_in_timeline(tl.test_timeline(lab_records(s, f))))
    ft = f"""SELECT 'Report_' || o.o_orderkey || '.pdf' AS file_name, count(r.row_ord) AS total, count(*) FILTER (WHERE {d.ABN_DASH('r."Status"')}) AS concerning, count(*) FILTER (WHERE {d.GOOD('r."Status"')}) AS good
      FROM orders o LEFT JOIN lab_records r ON r.report_id = o.o_orderkey GROUP BY o.o_orderkey"""
    for key in ("e12_counts_per_file", "j15_files_left_records"):
        query(key, ft, L)(lambda s, f: tl.file_trend(files(s, f), lab_records(s, f)))
    dd = f"coalesce({d.date_day_first(chr(34) + 'Test_Date' + chr(34))}, {FAR})"
    query("e24_report_timeline", f"""SELECT k.scope_id, k.date, k.lab, CAST(k.rank AS INTEGER) AS rank, k.tests_performed, coalesce(p.txt, 'None') AS abnormal_findings FROM
      (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY day, lab, f) AS rank FROM (SELECT scope_id, "Test_Date" AS date, "Lab_Name" AS lab, {dd} AS day, count(*) AS tests_performed, min(ROW("Test_Name", row_ord)) AS f
        FROM lab_records GROUP BY 1, 2, 3, 4) QUALIFY rank <= 12) k
      LEFT JOIN (SELECT scope_id, date, lab, string_agg(t, ', ' ORDER BY rn) AS txt FROM (SELECT scope_id, "Test_Date" AS date, "Lab_Name" AS lab, row_number() OVER (PARTITION BY scope_id, "Test_Date", "Lab_Name" ORDER BY "Test_Name", row_ord) AS rn,
        trim("Test_Name" || ': ' || "Result" || ' ' || coalesce("Unit", '') || ' (' || coalesce("Status", 'ABNORMAL') || ')') AS t FROM lab_records WHERE {d.ABN_CHAT('"Status"')}) WHERE rn <= 10 GROUP BY ALL) p
      ON p.scope_id = k.scope_id AND p.date = k.date AND p.lab = k.lab""", L)(lambda s, f: tl.report_timeline(lab_records(s, f)))
    SQL.add("recent", """SELECT k.scope_id, k.date, k.lab, CAST(k.place AS INTEGER) AS place, k.tests, coalesce(p.txt, 'None') AS abnormal FROM
      (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY day, first_ord) AS place FROM lastr) k
      LEFT JOIN (SELECT scope_id, date, lab, string_agg(name || ': ' || value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END || ' (' || severity || ')', ', ' ORDER BY rn) AS txt FROM
        (SELECT *, row_number() OVER (PARTITION BY scope_id, date, lab ORDER BY row_ord) AS rn FROM chatf WHERE severity <> 'NORMAL') WHERE rn <= 8 GROUP BY ALL) p
      ON p.scope_id = k.scope_id AND p.date = k.date AND p.lab = k.lab""", "lastr", "chatf")
    query("e24_recent_timeline", "SELECT * FROM recent", "recent")(lambda s, f: tl.recent_timeline(chatf(s, f)))
    SQL.add("parts", """SELECT r.*, t.timeline, coalesce(c.persistent, 'None') AS persistent, v.latest_values FROM drange r
      LEFT JOIN (SELECT scope_id, string_agg('Date: ' || date || ' | Lab: ' || lab || chr(10) || 'Tests performed: ' || tests || chr(10) || 'Abnormal findings: ' || abnormal, chr(10) || '---' || chr(10) ORDER BY place) AS timeline FROM recent GROUP BY 1) t USING (scope_id)
      LEFT JOIN (SELECT scope_id, string_agg(canonical || ' (abnormal in ' || abnormal_reports || ' reports)', chr(10) ORDER BY abnormal_reports DESC, canonical) AS persistent FROM persist GROUP BY 1) c USING (scope_id)
      LEFT JOIN (SELECT scope_id, string_agg(canonical || ': ' || latest_value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END || ' [' || latest_status || '] as of ' || latest_date, chr(10) ORDER BY rk) AS latest_values FROM
        (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY day DESC, first_ord) AS rk FROM latestc) WHERE rk <= 40 GROUP BY 1) v USING (scope_id)""", "drange", "recent", "persist", "latestc")
    query("p12_prompt_parts", "SELECT * FROM parts", "parts")(lambda s, f: tl.prompt_parts(chatf(s, f)))
    query("e25_persistent_concerns", "SELECT * FROM persist", "persist")(lambda s, f: tl.persistent_concerns(chatf(s, f)))
    query("e26_date_range", "SELECT * FROM drange", "drange")(lambda s, f: tl.date_range(chatf(s, f)))
    query("w02_latest_per_test", f"""SELECT scope_id, "Test_Name", "Test_Date", "Lab_Name", "Result", "Unit", "Status", row_ord FROM lab_records
      QUALIFY row_number() OVER (PARTITION BY scope_id, "Test_Name" ORDER BY {dd} DESC, "Lab_Name" DESC, row_ord DESC) = 1""", L)(lambda s, f: tl.latest_per_test(lab_records(s, f)))
    query("w02_latest_by_canonical", "SELECT scope_id, canonical, latest_value, unit, latest_status, latest_date FROM latestc", "latestc")(
        lambda s, f: tl.latest_by_canonical(chatf(s, f)).drop("day", "_first"))
    top = """SELECT scope_id, canonical, day, latest_value, unit, latest_status, latest_date, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY day DESC, first_ord) AS INTEGER) AS rank FROM latestc {} QUALIFY rank <= {}"""
    query("s06_top_snapshot", top.format("", 10), "latestc")(lambda s, f: tl.snapshot(chatf(s, f), 10))
    query("p14_fallback_findings", f"""SELECT scope_id, rank, '- ' || canonical || ': **' || CASE WHEN unit <> '' THEN latest_value || ' ' || unit ELSE latest_value END || '** (' || latest_status || ') on ' || latest_date AS line
      FROM ({top.format("WHERE latest_status <> 'NORMAL'", 5)})""", "latestc")(lambda s, f: tl.fallback_findings(chatf(s, f)))
    query("w12_first_picks", f"""SELECT report_id, arg_min("Test_Name", row_ord) FILTER (WHERE "Status" IS NOT NULL) AS first_with_status, arg_min("Test_Date", row_ord) FILTER (WHERE {CD} IS NOT NULL) AS first_dated FROM lab_records GROUP BY 1""", L)(
        lambda s, f: first_picks(lab_records(s, f)))


def first_picks(r):
    from labtrail.functions import values as va

    has = lambda c: F.when(c.isNotNull(), F.col("row_ord"))
    return r.groupBy("report_id").agg(
        F.min_by("Test_Name", has(F.col("Status"))).alias("first_with_status"),
        F.min_by("Test_Date", has(va.parse_client_date(F.col("Test_Date")))).alias("first_dated"))
