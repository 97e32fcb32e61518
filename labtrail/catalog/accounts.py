"""Accounts, studies, reports and the jobs over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.catalog import duck as d
from labtrail.catalog.records import normalized, report_files, resolved
from labtrail.catalog.registry import query
from labtrail.catalog.views import LABS, SQL, lab_records, pick, records_by_report, sql_list, table
from labtrail.operators import insights as ins
from labtrail.operators import studies as stu
from labtrail.operators.resolve import resolve_records
from labtrail.plans import jobs
from labtrail.plans import migration as mig
from labtrail.session import scratch_path
from labtrail.schema import RECORD_TEXT_FIELDS
from labtrail.sources.payloads import alerts_in_document



def profiles(s, f):
    c = table(s, f, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("profile_id"), F.col("c_nationkey").alias("owner_id"), F.col("c_name").alias("full_name"),
                    F.when(F.col("c_custkey") % 50 < 25, "Self").otherwise("parent").alias("relationship"))


def reports(s, f):
    o = table(s, f, "orders")
    cust, k = F.col("o_custkey"), F.col("o_orderkey")
    doc = F.concat(F.lit('{"health_summary": {"concerns": '), F.element_at(F.array(F.lit("[]"), F.lit('[{"test_name":"a"}]'), F.lit('[{},{"x":[1]}]'), F.lit('"none"')), (k % 4 + 1).cast("int")), F.lit("}}"))
    return o.select(
        k.alias("report_id"), F.concat(cust.cast("string"), F.lit("-"), F.year("o_orderdate").cast("string")).alias("study_id"), cust.cast("string").alias("profile_id"),
        F.when(k % 13 > 0, F.to_date("o_orderdate")).alias("report_date"), F.nullif(pick(LABS, (cust + F.when(k % 5 == 0, 1).otherwise(0)) % 7), F.lit("N/A")).alias("lab_name"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("uploaded_at"), alerts_in_document(doc).alias("alerts"))


def stored_reports(s, f):
    """Stored reports as JSON: even ones normalized by the current rules, of the
    odd ones some by older rules and some never."""
    r = records_by_report(s, f)
    texts = RECORD_TEXT_FIELDS
    raw = r.select("study_id", "report_id", "row_ord", "first_day", F.struct(*texts).alias("r"))
    even = "report_id % 2 = 0"
    done = resolve_records(r.where(even), jobs.REPORT, met=True, spelled_in=lab_records(s, f).where(even)).select("study_id", "report_id", "row_ord", F.struct(*texts, "Aliases").alias("r"))

    def packed(rows, name, *more):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "r"))), lambda x: x["r"])
        return rows.groupBy("study_id", "report_id").agg(listed.alias(name), *more)

    k = F.col("report_id")
    info = F.struct(
        F.when(k % 5 > 0, F.format_string("Name %d", k)).alias("name"), F.when(k % 5 != 1, (k % 90).cast("string")).alias("age"),
        F.when(k % 3 == 0, F.format_string("2024-01-0%d", k % 9 + 1)).alias("date"), F.lit("").alias("lab_name"))
    both = packed(raw, "raw", F.min("first_day").alias("report_date")).join(packed(done, "done"), ["study_id", "report_id"], "left")
    return both.select(
        "study_id", "report_id", F.substring_index("study_id", "-", 1).alias("profile_id"), F.format_string("Report_%d.pdf", k).alias("file_name"), "report_date",
        F.format_string("Lab %d", k % 7).alias("lab_name"), (k % 4 != 3).alias("is_normalized"), F.when(k % 2 == 0, 1).otherwise(0).alias("normalization_version"),
        F.when(k % 2 == 0, F.to_json("done")).alias("normalized_records"), F.to_json(F.struct(info.alias("patient_info"), F.col("raw").alias("records"))).alias("analysis_data"))


def studies(s, f):
    o = table(s, f, "orders")
    return o.groupBy(F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string")).alias("study_id"), F.col("o_custkey").cast("string").alias("profile_id")).agg(
        F.to_date(F.max("o_orderdate")).alias("updated_at"), F.to_date(F.min("o_orderdate")).alias("created_at"))


SQL.add("profiles", "SELECT CAST(c_custkey AS VARCHAR) AS profile_id, c_nationkey AS owner_id, c_name AS full_name, CASE WHEN c_custkey % 50 < 25 THEN 'Self' ELSE 'parent' END AS relationship FROM customer")
SQL.add("reports", f"""SELECT o_orderkey AS report_id, CAST(o_custkey AS VARCHAR) || '-' || year(o_orderdate) AS study_id, CAST(o_custkey AS VARCHAR) AS profile_id, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END AS report_date,
  nullif(({sql_list(LABS)})[(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 7 + 1], 'N/A') AS lab_name, CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS uploaded_at, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS alerts FROM orders""")
SQL.add("studies", "SELECT CAST(o_custkey AS VARCHAR) || '-' || year(o_orderdate) AS study_id, CAST(o_custkey AS VARCHAR) AS profile_id, CAST(max(o_orderdate) AS DATE) AS updated_at, CAST(min(o_orderdate) AS DATE) AS created_at FROM orders GROUP BY 1, 2")
SQL.add("items", """SELECT s.profile_id, s.study_id, count(r.report_id) AS report_count, min(r.report_date) AS range_start, max(r.report_date) AS range_end,
  CASE WHEN count(DISTINCT trim(r.lab_name)) = 1 THEN min(trim(r.lab_name)) END AS consistent_lab_name, CAST(coalesce(sum(alerts), 0) AS BIGINT) AS alerts_count, coalesce(sum(alerts), 0) > 0 AS has_alerts
  FROM studies s LEFT JOIN reports r ON r.study_id = s.study_id GROUP BY 1, 2""", "studies", "reports")
d.resolved_views("rep", "normalized", "study_id, report_id")
SQL.add("graded_norm", f"""SELECT n.*, CASE WHEN report_id % 2 = 0 THEN 'stored' ELSE 'legacy' END AS kind FROM normalized n""", "normalized")
SQL.add("rep_again", """SELECT r.* EXCLUDE (aliases, "Test_Name"), n.test_name AS "Test_Name", n.cluster, n.hint, n.score, list_distinct(list_concat(string_split(r.aliases, '|'), [n.raw, n.test_name])) AS "Aliases"
  FROM rep r JOIN name_map n ON n.raw = r."Original_Test_Name" WHERE r.study_id IN (SELECT study_id FROM rep WHERE report_id % 2 = 1)""", "rep", "name_map")
d.resolved_views("comb", "rep_again", "study_id")


def register() -> None:
    for key in ("e14_study_summary",):
        query(key, "SELECT s.*, coalesce(n, 0) AS report_count, a AS range_start, b AS range_end FROM studies s LEFT JOIN (SELECT study_id, count(*) AS n, min(report_date) AS a, max(report_date) AS b FROM reports GROUP BY 1) r USING (study_id)", "studies", "reports")(
            lambda s, f: stu.study_summary(studies(s, f), reports(s, f)))
    query("e13_study_items", "SELECT * FROM items", "items")(lambda s, f: stu.study_items(studies(s, f), reports(s, f)))
    query("j06_account_dashboard", """SELECT p.owner_id, count(*) AS profiles_tracked, CAST(coalesce(sum(i.s), 0) AS BIGINT) AS studies, CAST(coalesce(sum(i.r), 0) AS BIGINT) AS total_reports, CAST(coalesce(sum(i.a), 0) AS BIGINT) AS total_alerts
      FROM profiles p LEFT JOIN (SELECT profile_id, count(*) AS s, sum(report_count) AS r, sum(alerts_count) AS a FROM items GROUP BY 1) i USING (profile_id) GROUP BY 1""", "profiles", "items")(
        lambda s, f: stu.account_dashboard(profiles(s, f), studies(s, f), reports(s, f)))
    query("e43_profile_report_totals", "SELECT profile_id, CAST(sum(report_count) AS BIGINT) AS total_reports FROM items GROUP BY 1", "items")(lambda s, f: stu.profile_report_totals(studies(s, f), reports(s, f)))
    own = "SELECT s.study_id, s.profile_id FROM studies s JOIN profiles p USING (profile_id) WHERE p.owner_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"
    for key in ("b07_ownership_filter", "j07_access_semi_join"):
        query(key, own, "studies", "profiles")(lambda s, f: stu.accessible_studies(profiles(s, f), studies(s, f), table(s, f, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("owner_id"))).select("study_id", "profile_id"))
    at = lambda key, order: f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS INTEGER) AS place"
    query("s04_profiles_self_first", f"SELECT *, {at('owner_id', 'CASE WHEN lower(relationship) = \'self\' THEN 0 ELSE 1 END, full_name, profile_id')} FROM profiles", "profiles")(lambda s, f: stu.profiles_self_first(profiles(s, f)))
    query("a19_reports_of_study", f"SELECT study_id, report_id, report_date, uploaded_at, {at('study_id', 'report_date NULLS LAST, uploaded_at, report_id')} FROM reports", "reports")(
        lambda s, f: stu.reports_of_study(reports(s, f).select("study_id", "report_id", "report_date", "uploaded_at")))
    query("a19_profiles_of_owner", f"SELECT c_nationkey AS owner_id, CAST(c_custkey AS VARCHAR) AS profile_id, c_custkey % 9 AS created_at, {at('c_nationkey', 'c_custkey % 9, CAST(c_custkey AS VARCHAR)')} FROM customer")(
        lambda s, f: stu.profiles_of_owner(table(s, f, "customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").cast("string").alias("profile_id"), (F.col("c_custkey") % 9).alias("created_at"))))
    query("a19_studies_of_profile", f"SELECT study_id, profile_id, {at('profile_id', 'updated_at DESC, created_at DESC, study_id')} FROM studies", "studies")(
        lambda s, f: stu.studies_of_profile(studies(s, f)).select("study_id", "profile_id", "place"))
    query("a19_analyses_of_user", f"SELECT user_id, event_id AS id, {at('user_id', 'ts DESC, event_id')} FROM events")(
        lambda s, f: stu.analyses_of_user(table(s, f, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"))).select("user_id", "id", "place"))

    def history(s, f):
        o = table(s, f, "orders")
        k = F.col("o_orderkey").cast("string")
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("patient_name"), (F.col("o_orderkey") % 7).alias("total_records"),
                        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("a"), k, F.lit(".pdf,,b"), k)).alias("source_filenames"), F.col("o_orderdate").alias("created_at"))

    query("b12_history_rows", """SELECT o_orderkey AS id, o_orderpriority AS patient_name, o_orderkey % 7 AS total_records, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a' || o_orderkey || '.pdf|b' || o_orderkey END AS source_filenames,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders""")(
        lambda s, f: stu.history_rows(history(s, f)).withColumn("source_filenames", F.array_join("source_filenames", "|")))

    # jobs
    w = d.weight('"Status"', 0)

    def analyzed(s, f):
        r = lab_records(s, f)
        return jobs.analyze(r.where("report_id % 3 > 0"), r.where("report_id % 3 = 0"))["overall"]

    query("p07_analyze_batch", f"SELECT scope_id, CAST(floor(sum({w}) / count(*)) AS BIGINT) AS overall_score, count(*) AS total_tests FROM resolved GROUP BY 1", "resolved")(analyzed)

    def combined(s, f):
        r = lab_records(s, f)
        even = r.where("report_id % 2 = 0")
        stored = resolve_records(even, jobs.REPORT, met=True, spelled_in=even)  # lines meet their order, which is a report
        out = jobs.combined_reports(stored, r.where("report_id % 2 = 1"), report_files(s, f))
        return out.select("study_id", "row_ord", "Test_Name", "Test_Category", "Test_Date", F.array_join(F.array_sort("Aliases"), "|").alias("aliases"))

    query("p08_combined_report", """SELECT study_id, row_ord, "Test_Name", "Test_Category", "Test_Date", aliases FROM comb UNION ALL
      SELECT study_id, row_ord, "Test_Name", "Test_Category", "Test_Date", aliases FROM rep WHERE study_id NOT IN (SELECT study_id FROM rep WHERE report_id % 2 = 1)""", "comb", "rep")(combined)
    def study_summary(s, f):
        out = jobs.study_reports(stored_reports(s, f), profiles(s, f))
        totals = out["totals"].join(out["overall"], "study_id").join(out["patients"], "study_id")
        return totals.select("study_id", "reports", "reports_with_data", F.col("total_tests").alias("total_records"), "overall_score", "name", "age", "patient_id", "date", "lab_name")

    weight = d.weight('"Status"', 0)
    SQL.add("study_rows", """SELECT study_id, "Status" FROM comb UNION ALL SELECT study_id, "Status" FROM rep WHERE study_id NOT IN (SELECT study_id FROM rep WHERE report_id % 2 = 1)""", "comb", "rep")
    SQL.add("study_last", """SELECT study_id, max(report_id) AS last, min(report_id) AS first, count(DISTINCT report_id) AS reports FROM lab_records GROUP BY 1""", "lab_records")
    query("p08_study_report", f"""SELECT t.study_id, t.reports, t.reports AS reports_with_data, r.n AS total_records, r.overall_score,
      CASE WHEN last % 5 = 0 THEN p.full_name ELSE 'Name ' || last END AS name, CASE WHEN last % 5 = 1 THEN 'N/A' ELSE CAST(last % 90 AS VARCHAR) END AS age, CAST(p.owner_id AS VARCHAR) AS patient_id,
      CASE WHEN last % 3 = 0 THEN '2024-01-0' || (last % 9 + 1) ELSE coalesce(strftime(o.o_orderdate, '%Y-%m-%d'), 'N/A') END AS date, 'Lab ' || (first % 7) AS lab_name
      FROM study_last t JOIN (SELECT study_id, count(*) AS n, CAST(floor(sum({weight}) / count(*)) AS BIGINT) AS overall_score FROM study_rows GROUP BY 1) r USING (study_id)
      JOIN profiles p ON p.profile_id = string_split(t.study_id, '-')[1] JOIN (SELECT o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) o ON o.o_orderkey = t.last""", "study_last", "study_rows", "profiles")(study_summary)
    SQL.add("first_dates", f"SELECT report_id, arg_min(dt, row_ord) FILTER (WHERE dt IS NOT NULL) AS report_date FROM (SELECT *, {d.report_date(chr(34) + 'Test_Date' + chr(34))} AS dt FROM lab_records) GROUP BY 1", "lab_records")
    query("p09_save_to_study", """SELECT r.study_id, r.report_id, f.report_date, r.row_ord, r."Test_Name", r."Test_Category", 1 AS normalization_version FROM rep r JOIN first_dates f USING (report_id)""", "rep", "first_dates")(
        lambda s, f: jobs.save_reports(lab_records(s, f), report_files(s, f)).select("study_id", "report_id", "report_date", "row_ord", "Test_Name", "Test_Category", "normalization_version"))
    cols = ["Test_Name", "Original_Test_Name", "Test_Category", "Test_Date", "Result", "Unit", "Reference_Range", "Status", "Source_Filename"]
    packed = "list_sort(list(concat_ws('~', " + ", ".join(f"coalesce(\"{c}\", '<null>')" for c in cols) + ")))"
    query("p10_renormalize", f"""SELECT a.study_id, a.report_id, a.l <> b.l AS updated FROM (SELECT study_id, report_id, {packed} AS l FROM lab_records GROUP BY 1, 2) a
      JOIN (SELECT study_id, report_id, {packed} AS l FROM rep GROUP BY 1, 2) b USING (study_id, report_id)""", "lab_records", "rep")(lambda s, f: jobs.renormalize(lab_records(s, f))[1])
    query("p11_normalize_payload", f"SELECT study_id, report_id, CAST(floor(sum({w}) / count(*)) AS BIGINT) AS overall_score, count(*) AS total_tests FROM rep GROUP BY 1, 2", "rep")(
        lambda s, f: ins.overall_score(resolve_records(lab_records(s, f), jobs.REPORT), jobs.REPORT))

    def documents(s, f, broken: int):
        """One document a report: its rows and, for even reports, their number; some are no JSON."""
        r = records_by_report(s, f)
        first = F.min(F.struct("row_ord", F.struct(F.col("Patient_Name").alias("name"), F.col("Age").alias("age"), F.lit(None).cast("string").alias("gender"), F.col("Patient_ID").alias("patient_id"), F.lit("2024").alias("date"), F.lit("L").alias("lab_name")).alias("p")))
        rows = F.transform(F.array_sort(F.collect_list(F.struct("row_ord", F.struct(*cols).alias("r")))), lambda x: x["r"])
        doc = r.groupBy("study_id", "report_id").agg(rows.alias("records"), F.count("*").alias("n"), first["p"].alias("patient_info"))
        text = F.to_json(F.struct("records", F.when(F.col("report_id") % 2 == 0, F.col("n")).alias("total_records"), F.when(F.col("report_id") % 3 > 0, F.col("patient_info")).alias("patient_info")))
        return doc.select("study_id", "report_id", F.when(F.col("report_id") % broken == 0, F.lit('{"records": [')).otherwise(text).alias("text"))

    def old_reports(s, f):
        return documents(s, f, 11).withColumnRenamed("text", "analysis_data").withColumn("normalization_version", F.when(F.col("report_id") % 5 > 0, (F.col("report_id") % 2).cast("int")))

    def old_history(s, f):
        d_ = documents(s, f, 13)
        own = [F.lit(x).alias(c) for x, c in (("old", "patient_name"), ("1", "patient_age"), ("g", "patient_gender"), ("pid", "patient_id"), ("then", "report_date"), ("lab", "lab_name"))]
        # a study's reports are different documents
        return d_.select(F.concat_ws("/", "study_id", "report_id").alias("id"), *own, F.lit(-1).cast("long").alias("total_records"), F.col("text").alias("analysis_json"))

    SQL.add("doc_changes", f"""SELECT a.study_id, a.report_id, a.l <> b.l OR a.report_id % 2 = 1 OR a.n <> b.n AS updated, b.n FROM (SELECT study_id, report_id, count(*) AS n, {packed} AS l FROM lab_records GROUP BY 1, 2) a
      JOIN (SELECT study_id, report_id, count(*) AS n, {packed} AS l FROM rep GROUP BY 1, 2) b USING (study_id, report_id)""", "lab_records", "rep")
    SQL.add("doc_patient", """SELECT study_id, report_id, arg_min("Patient_Name", row_ord) AS name, arg_min("Age", row_ord) AS age, arg_min("Patient_ID", row_ord) AS pid FROM lab_records GROUP BY 1, 2""", "lab_records")
    SQL.add("moved", """SELECT study_id, report_id, CASE WHEN report_id % 11 = 0 THEN 0 ELSE n END AS total_records, updated OR report_id % 11 = 0 AS updated, CASE WHEN report_id % 5 > 0 THEN CAST(report_id % 2 AS INTEGER) ELSE 0 END AS source_version
      FROM doc_changes WHERE NOT (report_id % 5 > 0 AND report_id % 2 = 1)""", "doc_changes")
    SQL.add("moved_history", """SELECT c.study_id || '/' || c.report_id AS id, report_id % 13 > 0 AND updated AS updated, report_id % 13 = 0 AS skipped, c.n, c.report_id, p.name, p.age, p.pid FROM doc_changes c JOIN doc_patient p USING (study_id, report_id)""", "doc_changes", "doc_patient")
    query("p10_migrated_reports", "SELECT study_id, report_id, total_records, updated, source_version FROM moved", "moved")(
        lambda s, f: mig.migrate_reports(old_reports(s, f)).select("study_id", "report_id", "total_records", "updated", "source_version"))
    told = {"patient_name": ("name", "old"), "patient_age": ("age", "1"), "patient_gender": ("NULL", "g"), "patient_id": ("pid", "pid"), "report_date": ("'2024'", "then"), "lab_name": ("'L'", "lab")}
    query("p10_migrated_history", "SELECT id, updated, skipped, CASE WHEN updated THEN n ELSE -1 END AS total_records, " + ", ".join(
        f"CASE WHEN updated AND report_id % 3 > 0 THEN {new} ELSE '{old}' END AS {c}" for c, (new, old) in told.items()) + " FROM moved_history", "moved_history")(
        lambda s, f: mig.migrate_history(old_history(s, f)).drop("normalized_records"))

    def totals(s, f):
        found = mig.migrate(old_reports(s, f), old_history(s, f), scratch_path(s, "migration"))
        return s.createDataFrame([(k, v["updated"], v["unchanged"], v.get("skipped", 0)) for k, v in found.items()], "kind string, updated long, unchanged long, skipped long")

    query("p10_migration_totals", """SELECT 'reports' AS kind, count(*) FILTER (WHERE updated) AS updated, count(*) FILTER (WHERE NOT updated) AS unchanged, 0 AS skipped FROM moved
      UNION ALL SELECT 'history', count(*) FILTER (WHERE updated), count(*) FILTER (WHERE NOT updated AND NOT skipped), count(*) FILTER (WHERE skipped) FROM moved_history""", "moved", "moved_history")(totals)
