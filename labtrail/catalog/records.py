"""Filters, joins on names and categories, duplicate resolution, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.catalog import duck as d
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, table
from labtrail.functions import status as st
from labtrail.operators import insights as ins
from labtrail.operators import records as rec
from labtrail.operators import resolve as res
from labtrail.schema import pad_columns



def normalized(spark, sf):
    return res.normalize_records(lab_records(spark, sf))


def resolved(spark, sf):
    return res.resolve_records(lab_records(spark, sf))


OUT = ["scope_id", "row_ord", "Test_Date", "Test_Name", "Original_Test_Name", "Test_Category", "Result", "Unit", "Reference_Range", "Status"]
OUT_SQL = 'scope_id, row_ord, "Test_Date", "Test_Name", "Original_Test_Name", "Test_Category", "Result", "Unit", "Reference_Range", "Status"'


def with_sorted_aliases(df):
    return df.select(*OUT, F.array_join(F.array_sort("Aliases"), "|").alias("aliases"))


def payload_rows(spark, sf):
    """Payload rows whose file names fit their report to different degrees."""
    r = lab_records(spark, sf)
    k, i = F.col("report_id") % 4, F.col("report_id").cast("string")
    odd = F.length("Result") % 2 == 0
    name = (
        F.when((k == 1) & odd, F.lit("other.pdf")).when(k == 2, F.concat(F.lit("scan/Report_"), i, F.lit("_page.PDF")))
        .when(k == 3, F.lit("zzz.pdf")).otherwise(F.col("Source_Filename"))
    )
    return r.withColumn("Source_Filename", name)


def report_files(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.concat(F.lit("Report_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"))


SQL.add("payload_rows", """SELECT * REPLACE (CASE WHEN report_id % 4 = 1 AND length("Result") % 2 = 0 THEN 'other.pdf'
  WHEN report_id % 4 = 2 THEN 'scan/Report_' || report_id || '_page.PDF' WHEN report_id % 4 = 3 THEN 'zzz.pdf' ELSE "Source_Filename" END AS "Source_Filename")
  FROM lab_records""", "lab_records")
SQL.add("graded_rows", f"""SELECT *, {d.file_key('"Source_Filename"')} AS own, 'report_' || report_id || '.pdf' AS target FROM payload_rows""", "payload_rows")


def register() -> None:
    L = "lab_records"
    # filters
    query("b01_pad_columns", f'SELECT row_ord, "Test_Name", \'N/A\' AS "Method", NULL::VARCHAR AS "Panel" FROM lab_records', L)(
        lambda s, f: pad_columns(pad_columns(lab_records(s, f).select("row_ord", "Test_Name"), ["row_ord", "Test_Name", "Method"], "N/A"), ["row_ord", "Test_Name", "Method", "Panel"]))
    query("b02_drop_empty", """SELECT row_ord FROM lab_records WHERE NOT ("Test_Category" IS NULL AND "Status" IS NULL)""", L)(
        lambda s, f: rec.drop_empty(lab_records(s, f).select("row_ord", F.col("Test_Category").alias("Test_Name"), F.col("Status").alias("Result"))).select("row_ord"))
    query("b03_valid_for_display", """SELECT scope_id, count(*) AS n FROM lab_records WHERE "Test_Name" IS NOT NULL AND "Test_Name" <> 'N/A' AND "Result" IS NOT NULL GROUP BY 1""", L)(
        lambda s, f: ins.valid_for_display(lab_records(s, f), True).groupBy("scope_id").agg(n_rows().alias("n")))
    flags = {"score": (st.abnormal_score, d.ABN_SCORE), "chat": (st.abnormal_chat, d.ABN_CHAT), "dash": (st.abnormal_dash, d.ABN_DASH),
             "tree": (st.abnormal_tree, d.ABN_TREE), "panel": (st.abnormal_panel, d.ABN_PANEL), "migration": (st.abnormal_migration, d.ABN_MIGR),
             "print": (st.abnormal_print, d.ABN_PDF), "good": (st.good, d.GOOD)}
    query("b04_status_predicates", 'SELECT "Status" AS status, count(*) AS n, ' + ", ".join(f"""any_value({q('"Status"')}) AS "{k}" """ for k, (_, q) in flags.items()) + " FROM lab_records GROUP BY 1", L)(
        lambda s, f: lab_records(s, f).groupBy(F.col("Status").alias("status")).agg(n_rows().alias("n")).select("status", "n", *[p(F.col("status")).alias(k) for k, (p, _) in flags.items()]))

    def facets(s, f):
        r = normalized(s, f)
        blood = rec.facet_rows(r, "Blood")
        part = lambda df, c, kind: rec.facet_values(df, c).select(F.lit(kind).alias("facet"), F.col(c).alias("value"))
        lipid = rec.facet_rows(r, "Blood", "Lipid Profile")
        return part(blood, "Test_Category", "category").unionByName(part(lipid, "Test_Name", "test")).unionByName(
            part(rec.facet_rows(r, "Blood", "Lipid Profile", "LDL Cholesterol"), "Test_Date", "date"))

    keep = """FROM normalized WHERE "Test_Name" NOT IN ('N/A', 'UnknownTest', 'Unknown Test') AND "Test_Category" IN (SELECT category FROM body_t WHERE part = 'Blood')"""
    query("b05_facet_cascade", f"""SELECT DISTINCT 'category' AS facet, "Test_Category" AS value {keep} UNION ALL
      SELECT DISTINCT 'test', "Test_Name" {keep} AND "Test_Category" = 'Lipid Profile' UNION ALL
      SELECT DISTINCT 'date', "Test_Date" {keep} AND "Test_Category" = 'Lipid Profile' AND "Test_Name" = 'LDL Cholesterol' """, "normalized", "body_t")(facets)
    query("b06_search", """SELECT row_ord FROM lab_records WHERE "Test_Name" <> 'N/A' AND (contains(lower(coalesce("Test_Category", 'Uncategorized')), 'thyroid') OR contains(lower("Test_Name"), 'thyroid'))""", L)(
        lambda s, f: rec.search(lab_records(s, f), " Thyroid ").select("row_ord"))
    query("b10_fill_source_file", """SELECT row_ord, coalesce("Source_Filename", 'upload_' || scope_id || '.pdf') AS "Source_Filename" FROM
      (SELECT row_ord, scope_id, CASE WHEN "Status" IS NULL THEN NULL ELSE "Source_Filename" END AS "Source_Filename" FROM lab_records)""", L)(
        lambda s, f: rec.with_source_file(lab_records(s, f).select("row_ord", "scope_id", F.when(F.col("Status").isNull(), " ").otherwise(F.col("Source_Filename")).alias("sourceFileName")),
                                          F.concat(F.lit("upload_"), F.col("scope_id"), F.lit(".pdf"))).select("row_ord", "Source_Filename"))

    def for_output(s, f):
        e = table(s, f, "events")
        v = F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
        return rec.cleaned_for_output(e.select("event_id", v.alias("value"), "ts", F.to_date("ts").alias("day")))

    query("b11_clean_for_output", "SELECT event_id, CASE WHEN value >= 1 THEN value END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, strftime(ts, '%Y-%m-%dT00:00:00') AS day FROM events")(for_output)
    query("b13_sanitize_history", "SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")(
        lambda s, f: rec.clean_turns(table(s, f, "conversations")))
    best = "SELECT report_id, row_ord FROM (SELECT *, {lv} AS lv FROM graded_rows) QUALIFY lv = min(lv) OVER (PARTITION BY report_id)"
    query("b08_slice_by_file", best.format(lv="CASE WHEN own = target THEN 1 ELSE 2 END"), "graded_rows")(
        lambda s, f: rec.slice_by_file(payload_rows(s, f), report_files(s, f), True).select("report_id", "row_ord"))
    stem = f"CASE WHEN own = target THEN 1 WHEN contains({d.file_stem('own')}, {d.file_stem('target')}) OR contains({d.file_stem('target')}, {d.file_stem('own')}) THEN 2 ELSE 3 END"
    for key in ("b09_slice_deterministic", "j11_report_record_files"):
        query(key, best.format(lv=stem), "graded_rows")(
            lambda s, f: rec.slice_deterministic(payload_rows(s, f), report_files(s, f)).select("report_id", "row_ord"))

    # name and category joins
    query("j01_alias_join", 'SELECT "Test_Name", count(*) AS n, count(DISTINCT "Original_Test_Name") AS spellings FROM normalized GROUP BY 1', "normalized")(
        lambda s, f: normalized(s, f).groupBy("Test_Name").agg(n_rows().alias("n"), F.countDistinct("Original_Test_Name").alias("spellings")))
    query("j02_category_containment", 'SELECT "Test_Category", count(*) AS n FROM normalized GROUP BY 1', "normalized")(
        lambda s, f: normalized(s, f).groupBy("Test_Category").agg(n_rows().alias("n")))
    query("j03_category_hint", 'SELECT "Test_Name", hint, count(*) AS n FROM normalized GROUP BY ALL', "normalized")(
        lambda s, f: normalized(s, f).groupBy("Test_Name", F.col("_hint").alias("hint")).agg(n_rows().alias("n")))
    query("j04_same_test_groups", 'SELECT scope_id, cluster, count(DISTINCT "Original_Test_Name") AS spellings, count(*) AS n FROM normalized GROUP BY ALL', "normalized")(
        lambda s, f: normalized(s, f).groupBy("scope_id", F.col("_cluster").alias("cluster")).agg(F.countDistinct("Original_Test_Name").alias("spellings"), n_rows().alias("n")))
    query("j05_category_body_parts", """SELECT n.scope_id, coalesce(b.part, 'General') AS part, count(*) AS n FROM normalized n LEFT JOIN body_t b ON b.category = n."Test_Category" GROUP BY ALL""", "normalized", "body_t")(
        lambda s, f: ins.body_system_tests(normalized(s, f)).groupBy("scope_id", F.col("system").alias("part")).agg(n_rows().alias("n")))
    query("j08_category_counts", 'SELECT scope_id, "Test_Name", "Test_Category", count(DISTINCT "Test_Date") AS date_count, count(*) AS row_count FROM lab_records GROUP BY ALL', L)(
        lambda s, f: rec.category_counts(lab_records(s, f)))
    bc = """(SELECT scope_id, "Test_Name", arg_min(c, ROW(-d, -n, c)) AS best FROM (SELECT scope_id, "Test_Name", "Test_Category" AS c, count(DISTINCT "Test_Date") AS d, count(*) AS n
      FROM normalized GROUP BY ALL) GROUP BY ALL)"""
    dup = f"""SELECT r.scope_id, r."Test_Name", r."Test_Date", b.best AS "Test_Category", r.row_ord, r."Result" FROM
      (SELECT * FROM normalized QUALIFY row_number() OVER (PARTITION BY scope_id, "Test_Name", "Test_Date" ORDER BY row_ord) = 1) r LEFT JOIN {bc} b USING (scope_id, "Test_Name")"""
    for key in ("e44_combine_duplicate_tests", "w08_category_rank_first_row", "j09_best_category_join"):
        query(key, dup, "normalized")(lambda s, f: rec.combine_duplicate_tests(normalized(s, f)).select("scope_id", "Test_Name", "Test_Date", "Test_Category", "row_ord", "Result"))

    # resolution
    query("p01_normalize_record", f"""SELECT {OUT_SQL}, array_to_string(list_sort("Aliases"), '|') AS aliases FROM normalized""", "normalized")(
        lambda s, f: with_sorted_aliases(normalized(s, f)))
    query("p02_same_test_classes", 'SELECT "Test_Name" AS name, cluster, count(*) AS n FROM normalized GROUP BY ALL', "normalized")(
        lambda s, f: normalized(s, f).groupBy(F.col("Test_Name").alias("name"), F.col("_cluster").alias("cluster")).agg(n_rows().alias("n")))
    full = f"SELECT {OUT_SQL}, aliases FROM resolved"
    query("p04_deduplicate", full, "resolved")(lambda s, f: with_sorted_aliases(res.deduplicate(normalized(s, f))))
    query("p05_normalize_records", full, "resolved")(lambda s, f: with_sorted_aliases(resolved(s, f)))
    query("w01_merge_readings", 'SELECT scope_id, cluster, row_ord, "Test_Date", "Result" FROM resolved_best', "resolved_best")(
        lambda s, f: res.merge_readings(normalized(s, f), ["scope_id", "_cluster"]).select("scope_id", F.col("_cluster").alias("cluster"), "row_ord", "Test_Date", "Result"))
    query("e37_alias_union", "SELECT scope_id, cluster, aliases FROM resolved_al", "resolved_al")(
        lambda s, f: res.cluster_facts(normalized(s, f), ["scope_id", "_cluster"]).select("scope_id", F.col("_cluster").alias("cluster"), F.array_join(F.array_sort("_all_aliases"), "|").alias("aliases")))
    query("e38_resolve_category", """SELECT p.scope_id, p.cluster, p.name, coalesce(p.hint, v.cat, 'Other') AS category FROM resolved_pick p LEFT JOIN resolved_votes v
      ON v.scope_id = p.scope_id AND v.cluster = p.cluster AND v.rk = 1""", "resolved_pick", "resolved_votes")(
        lambda s, f: res.cluster_facts(normalized(s, f), ["scope_id", "_cluster"]).select("scope_id", F.col("_cluster").alias("cluster"), F.col("_canonical").alias("name"), F.col("_resolved").alias("category")))

    # order and sets
    query("s01_sort_by_date", f"""SELECT *, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY "Test_Date_dt" NULLS LAST, "Test_Category" NULLS LAST, "Test_Name" NULLS LAST, row_ord) AS INTEGER) AS place
      FROM (SELECT scope_id, row_ord, {d.date_day_first('"Test_Date"')} AS "Test_Date_dt", "Test_Category", "Test_Name" FROM lab_records)""", L)(
        lambda s, f: rec.in_date_order(rec.with_typed_columns(lab_records(s, f))).select("scope_id", "row_ord", "Test_Date_dt", "Test_Category", "Test_Name", "place"))
    query("s02_sort_resolved", f'''SELECT scope_id, "Test_Date", "Test_Name", row_ord, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY {d.sort_date('"Test_Date"')} NULLS LAST, "Test_Name", row_ord) AS INTEGER) AS place FROM resolved''', "resolved")(
        lambda s, f: res.in_report_order(resolved(s, f)).select("scope_id", "Test_Date", "Test_Name", "row_ord", "place"))
    tree = f"""SELECT scope_id, category, "Test_Name", row_ord, CASE WHEN {d.ABN_TREE('"Status"')} THEN 0 ELSE 1 END AS abnormal_rank,
      CASE WHEN lower("Status") = 'critical' THEN 0 WHEN lower("Status") IN ('high','positive','flagged') THEN 1 WHEN lower("Status") IN ('low','insufficient') THEN 2
      WHEN lower("Status") IN ('normal','negative') THEN 3 ELSE 4 END AS severity_rank, {d.client_date('"Test_Date"')} AS day,
      CAST(sum(CASE WHEN {d.ABN_TREE('"Status"')} THEN 1 ELSE 0 END) OVER (PARTITION BY scope_id, category) AS BIGINT) AS alert_count
      FROM (SELECT *, coalesce({d.nz('"Test_Category"')}, 'Uncategorized') AS category FROM lab_records WHERE "Test_Name" <> 'N/A')"""
    query("e41_category_tree", tree, L)(lambda s, f: rec.organized_tree(lab_records(s, f)))
    query("s05_tree_sort", f"""SELECT *, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY alert_count DESC, category, abnormal_rank, severity_rank, day NULLS LAST, "Test_Name", row_ord) AS INTEGER) AS place FROM ({tree})""", L)(
        lambda s, f: rec.in_tree_order(rec.organized_tree(lab_records(s, f))))

    def halves(s, f):
        r = lab_records(s, f)
        old = r.where(F.col("report_id") % 2 == 0).select("row_ord", "Test_Name", "Result")
        new = r.where(F.col("report_id") % 2 == 1).select("row_ord", "Test_Name", "Unit", "Status")
        return rec.combine(old, new, "N/A")

    query("s07_union_existing_new", """SELECT row_ord, "Test_Name", CASE WHEN report_id % 2 = 0 THEN "Result" ELSE 'N/A' END AS "Result",
      CASE WHEN report_id % 2 = 1 THEN "Unit" ELSE 'N/A' END AS "Unit", CASE WHEN report_id % 2 = 1 THEN "Status" ELSE 'N/A' END AS "Status" FROM lab_records""", L)(halves)
    sig = ["scope_id", "Test_Name", "Test_Category", "Result", "Unit", "Reference_Range", "Status"]
    query("s08_distinct_rows", "SELECT DISTINCT " + ", ".join(f'"{c}"' for c in sig) + " FROM lab_records", L)(
        lambda s, f: rec.distinct_rows(lab_records(s, f).select(*sig, "row_ord"), sig).drop("row_ord"))
    query("s09_distinct_readings", """SELECT scope_id, "Test_Name", "Test_Date", "Result", "Patient_ID", min(row_ord) AS row_ord FROM lab_records GROUP BY ALL""", L)(
        lambda s, f: rec.distinct_rows(lab_records(s, f).select("scope_id", "Test_Name", "Test_Date", "Result", "Patient_ID", "row_ord"), ["scope_id", "Test_Name", "Test_Date", "Result", "Patient_ID"]))
    query("s10_distinct_facets", """SELECT DISTINCT "Test_Category" AS value FROM lab_records WHERE "Test_Category" IS NOT NULL""", L)(
        lambda s, f: rec.facet_values(lab_records(s, f), "Test_Category").withColumnRenamed("Test_Category", "value"))
    query("w06_last_turns", """SELECT conv_id, turn, role FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")(
        lambda s, f: rec.last_turns(rec.clean_turns(table(s, f, "conversations")), 6).select("conv_id", "turn", "role"))
    query("e19_consistency_report", f"""SELECT scope_id, issue, records FROM (
      SELECT scope_id, 'Missing Test_Name' AS issue, count(*) AS records FROM lab_records WHERE "Test_Name" IS NULL OR "Test_Name" = 'N/A' GROUP BY 1
      UNION ALL SELECT scope_id, 'Missing Result', count(*) FROM lab_records WHERE "Result" IS NULL OR "Result" = 'N/A' GROUP BY 1
      UNION ALL SELECT scope_id, 'Missing Test_Date', count(*) FROM lab_records WHERE "Test_Date" IS NULL OR "Test_Date" = 'N/A' GROUP BY 1
      UNION ALL SELECT scope_id, 'Invalid date formats', count(*) FROM lab_records WHERE {d.date_day_first('"Test_Date"')} IS NULL AND "Test_Date" <> 'N/A' GROUP BY 1
      UNION ALL SELECT scope_id, 'Duplicate test dates', count(*) FROM (SELECT scope_id FROM lab_records GROUP BY scope_id, "Test_Name", "Test_Date" HAVING count(*) > 1) GROUP BY 1)""", L)(
        lambda s, f: rec.consistency_report(lab_records(s, f)))
    query("e39_records_per_source", 'SELECT "Source_Filename", count(*) AS records FROM lab_records GROUP BY 1', L)(
        lambda s, f: rec.records_per_source(lab_records(s, f)))
