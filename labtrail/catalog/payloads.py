"""Payload scans, earlier exports, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.catalog import duck as d
from labtrail.catalog.insights import YEAR_LABS, yearly
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, table
from labtrail.operators import insights as ins
from labtrail.functions import status as st
from labtrail.sources import history as his
from labtrail.sources import payloads as pay
from labtrail.sources import sinks
from labtrail.schema import RECORD_TEXT_FIELDS
from labtrail.session import materialize, scratch_path



def report_payloads(s, f):
    """One extraction payload per record, some of them malformed."""
    r = lab_records(s, f)
    k = F.col("report_id") % 7
    info = F.to_json(F.struct(F.col("Patient_Name").alias("name"), F.col("Age").alias("age"), F.col("Gender").alias("gender"), F.col("Patient_ID").alias("patient_id"), F.col("Test_Date").alias("date"), F.col("Lab_Name").alias("lab_name")))
    test = F.to_json(F.struct(F.col("Original_Test_Name").alias("test_name"), F.col("Result").alias("result"), F.col("Unit").alias("unit"), F.col("Reference_Range").alias("reference_range"), F.col("Status").alias("status"), F.col("Test_Category").alias("category")))
    doc = (
        F.when(k == 0, F.concat(F.lit('{"test_results": ['), test, F.lit("]}")))
        .when(k == 1, F.concat(F.lit('{"patient_info": '), info, F.lit(', "test_results": ['), test, F.lit(', {"test_name": "X"}, "junk"]}')))
        .when(k == 2, F.concat(F.lit('{"patient_info": '), info, F.lit(', "test_results": ['), test, F.lit('], "abnormal_findings_summary_from_report": " high sugar "}')))
        .when(k == 3, F.lit('{"broken": '))
        .when(k == 4, F.concat(F.lit('{"patient_info": '), info, F.lit(', "test_results": '), test, F.lit("}")))
        .otherwise(F.concat(F.lit('{"patient_info": '), info, F.lit(', "test_results": ['), test, F.lit('], "abnormal_findings_summary_from_report": ["a", " ", "b"]}')))
    )
    return r.select("row_ord", "report_id", "scope_id", "Source_Filename", doc.alias("payload"))


def wide_history(s, f):
    """Wide table of every scope: one column per year and laboratory."""
    cells = ins.organized_cells(yearly(s, f))
    refs = ins.common_ranges(yearly(s, f)).withColumnRenamed("Reference_Range", "Reference_Ranges")
    keys = ["scope_id", "Test_Category", "Test_Name"]
    return ins.organized_table(cells, YEAR_LABS).join(refs, keys, "left")


SQL.add("yref", """SELECT scope_id, "Test_Category", "Test_Name", arg_min("Reference_Range", ROW(-n, o)) AS ref FROM (SELECT scope_id, "Test_Category", "Test_Name", "Reference_Range", count(*) AS n, min(ROW(DATE '0001-01-01', date_lab)) AS o
  FROM ycells_ref WHERE trim("Reference_Range") <> '' AND "Reference_Range" <> 'N/A' GROUP BY ALL) GROUP BY ALL""", "ycells_ref")
SQL.add("wide_cells", """SELECT c.scope_id, trim(c."Test_Category") AS "Test_Category", trim(c."Test_Name") AS "Test_Name", string_split(date_lab, '_')[1] AS "Test_Date", string_split(date_lab, '_')[2] AS "Lab_Name", c."Result",
  coalesce(r.ref, 'N/A') AS "Reference_Range" FROM ycells c LEFT JOIN yref r USING (scope_id, "Test_Category", "Test_Name")""", "ycells", "yref")
CELL = ["scope_id", "Test_Category", "Test_Name", "Test_Date", "Lab_Name", "Result", "Reference_Range"]
CELL_SQL = ", ".join(f'"{c}"' for c in CELL)
SQL.add("checked", """SELECT *, report_id % 7 AS k FROM lab_records""", "lab_records")


def checked(s, f):
    return pay.validate_payloads(report_payloads(s, f))


def register() -> None:
    L = "lab_records"

    def csv_round_trip(s, f):
        path = scratch_path(s, "wide-csv")
        sinks.write_organized_csv(wide_history(s, f), path)
        return his.unpivot_history(his.read_csv(s, path), "medical_report_1_asha_rao.csv", carry=["scope_id"]).select(*CELL)

    def trimmed(df):
        return df.select(*[F.trim(c).alias(c) if c in ("Test_Category", "Test_Name") else F.col(c) for c in CELL])

    query("a01_read_wide_csv", f"SELECT {CELL_SQL} FROM wide_cells", "wide_cells")(csv_round_trip)

    def stacked(s, f):
        path = scratch_path(s, "stacked")
        write_stacked(s, flat_history(s, f), path, YEAR_LABS)
        return his.read_stacked_files(s, path).select(*CELL[1:])

    def stacked_files(s, f):
        path = scratch_path(s, "stacked-files")
        wide = flat_history(s, f)
        for k in range(3):  # each file has its own columns
            write_stacked(s, wide, path, YEAR_LABS[k::3])
        return his.read_stacked_files(s, path).select(*CELL[1:])

    def flat_history(s, f):
        """The wide table of all scopes, the least value of each cell; written once, as it has a row a test.  Cells are reduced before they are spread to columns."""
        test = ["Test_Category", "Test_Name"]
        cells = ins.organized_cells(yearly(s, f)).groupBy(*test, "date_lab").agg(F.min("Result").alias("Result"))
        refs = ins.common_ranges(yearly(s, f)).groupBy(*test).agg(F.min("Reference_Range").alias("Reference_Ranges"))
        return materialize(cells.groupBy(*test).pivot("date_lab", YEAR_LABS).agg(F.min("Result")).join(refs, test, "left"), "flat-history")

    def write_stacked(s, wide, path, cols):
        line = lambda pre, vals: F.concat_ws(",", *[F.lit(v) for v in [*pre, *vals]])
        one = s.range(1)
        title = one.select(F.lit(0).alias("o"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("value")) for i, t in enumerate([
            line(["title"], [""] * (len(cols) + 2)), line(["Date", ""], [c.split("_")[0] for c in cols] + ["Reference Ranges"]),
            line(["Lab", ""], [c.split("_")[1] for c in cols] + [""]), line(["", ""], [""] * (len(cols) + 1))])])).alias("e")).select("o", "e.i", "e.value")
        quote = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
        body = wide.select(F.lit(1).alias("o"), F.lit(9).alias("i"), F.concat_ws(",", *[quote(F.col(f"`{c}`")) for c in ["Test_Category", "Test_Name", *cols, "Reference_Ranges"]]).alias("value"))
        # one file, as such an export is; its size is that of the test vocabulary
        title.unionByName(body).coalesce(1).sortWithinPartitions("o", "i").select("value").write.mode("append").text(path)

    SQL.add("flat_cells", """SELECT "Test_Category", "Test_Name", date_lab, min("Result") AS "Result" FROM ycells GROUP BY ALL""", "ycells")
    flat = """SELECT trim(c."Test_Category") AS "Test_Category", trim(c."Test_Name") AS "Test_Name", string_split(date_lab, '_')[1] AS "Test_Date", string_split(date_lab, '_')[2] AS "Lab_Name", "Result",
      coalesce(r.ref, 'N/A') AS "Reference_Range" FROM flat_cells c LEFT JOIN (SELECT "Test_Category", "Test_Name", min(ref) AS ref FROM yref GROUP BY ALL) r USING ("Test_Category", "Test_Name")"""
    query("a02_stacked_headers", flat, "flat_cells", "yref")(stacked)
    query("a02_stacked_files", flat, "flat_cells", "yref")(stacked_files)
    query("a03_unpivot", f"SELECT {CELL_SQL} FROM wide_cells", "wide_cells")(lambda s, f: his.unpivot_history(wide_history(s, f), "x.csv", carry=["scope_id"]).select(*CELL))

    def variant(s, f):
        w = wide_history(s, f)
        for c in YEAR_LABS:
            w = w.withColumnRenamed(c, c) if "City" not in c else w.withColumnRenamed(c, f"1-2-{c[:4]}")
        return his.unpivot_history(w, "x.csv", {"name": "P"}, default_lab="General Lab", reformat_dates=True, carry=["scope_id"]).select(*CELL)

    query("a04_unpivot_variant", """SELECT * REPLACE (CASE WHEN "Lab_Name" = 'City Lab' THEN '01-02-' || "Test_Date" ELSE "Test_Date" END AS "Test_Date", CASE WHEN "Lab_Name" = 'City Lab' THEN 'General Lab' ELSE "Lab_Name" END AS "Lab_Name") FROM wide_cells""", "wide_cells")(variant)

    def detected(s, f):
        labs = [c for c in YEAR_LABS if c.endswith("City Lab")]
        w = wide_history(s, f).select("scope_id", "Test_Name", *[F.col(f"`{c}`").alias(f"1-2-{c[:4]}") for c in labs])
        return his.detect_and_unpivot(w, "x.csv", carry=["scope_id"]).select("scope_id", "Test_Category", "Test_Name", "Test_Date", "Lab_Name", "Result")

    query("a05_detect_format", """SELECT scope_id, 'General' AS "Test_Category", "Test_Name", '1-2-' || "Test_Date" AS "Test_Date", 'General Lab' AS "Lab_Name", "Result" FROM wide_cells WHERE "Lab_Name" = 'City Lab'""", "wide_cells")(detected)
    query("a06_read_long_export", f"""SELECT row_ord, 'export.csv' AS "Source_Filename", "Test_Name", {d.strict_numeric('"Result"')} AS "Result_Numeric", {d.date_day_first('"Test_Date"')} AS "Test_Date_dt", 'N/A' AS "Gender" FROM lab_records WHERE "Test_Name" <> 'N/A'""", L)(
        lambda s, f: his.read_long_export(lab_records(s, f).drop("Gender"), "export.csv").select("row_ord", "Source_Filename", "Test_Name", "Result_Numeric", "Test_Date_dt", "Gender"))
    query("a07_validate_payload", f"""SELECT row_ord, k NOT IN (0, 3, 4) AS is_valid, CAST(CASE WHEN k IN (3, 4) THEN 0 ELSE 1 END AS INTEGER) AS n_tests, CASE k WHEN 0 THEN 'patient_info is not an object' WHEN 1 THEN 'dropped entries: 2' WHEN 3 THEN 'not a JSON object'
      WHEN 4 THEN 'test_results is not an array|no usable entry' ELSE '' END AS issues, CASE k WHEN 2 THEN 'high sugar' WHEN 5 THEN 'a|b' WHEN 6 THEN 'a|b' ELSE '' END AS summary,
      CASE WHEN k IN (0, 3) THEN 'N/A' ELSE {d.fmt_date(d.date_day_first('"Test_Date"'))} END AS date FROM checked""", "checked")(
        lambda s, f: checked(s, f).select("row_ord", "is_valid", F.size("test_results").alias("n_tests"), F.array_join("issues", "|").alias("issues"), F.array_join("summary", "|").alias("summary"), F.col("patient_info.date").alias("date")))
    from labtrail import fixed_values as fv

    ident = lambda v: v
    d_raw = d.patterns(d.strip('"Original_Test_Name"'), fv.TEST_NAME_PATTERNS, str.title, d.title(d.strip('"Original_Test_Name"')))
    SQL.add("rec_std", f"SELECT raw, {d_raw} AS std FROM (SELECT DISTINCT \"Original_Test_Name\" AS raw, \"Original_Test_Name\" FROM lab_records)", L)
    SQL.add("rec_key", f"SELECT raw, std, {d.structural_clean('std')} AS key FROM rec_std", "rec_std")
    SQL.add("rec_name", f"SELECT raw, CASE WHEN {d.missing('std')} THEN 'Unknown Test' ELSE {d.known_name('key')} END AS name FROM rec_key", "rec_key", "alias_t", "alias_lk")
    query("a08_record_rows", f"""SELECT r.row_ord, CAST(0 AS INTEGER) AS pos, CASE WHEN k = 0 THEN 'N/A' ELSE {d.fmt_date(d.date_day_first('r."Test_Date"'))} END AS "Test_Date", c.category AS "Test_Category", n.name AS "Test_Name", r."Result",
      {d.patterns(d.strip('r."Unit"'), fv.UNIT_PATTERNS, ident, d.strip('r."Unit"'))} AS "Unit", {d.canonical_status('r."Status"')} AS "Status" FROM checked r JOIN rec_name n ON n.raw = r."Original_Test_Name"
      JOIN cat_map c ON c.raw IS NOT DISTINCT FROM r."Test_Category" WHERE k NOT IN (3, 4)""", "checked", "rec_name", "cat_map")(
        lambda s, f: pay.record_rows(checked(s, f), F.col("Source_Filename"), ["row_ord"]).select("row_ord", "pos", "Test_Date", "Test_Category", "Test_Name", "Result", "Unit", "Status"))

    def documents(s, f):
        r = lab_records(s, f)
        rec = F.to_json(F.struct(
            *RECORD_TEXT_FIELDS, F.array("Original_Test_Name", "Lab_Name").alias("Aliases"), F.lit("2024-05-06").alias("Processed_Date"),
            F.col("report_id").cast("double").alias("Result_Numeric"), F.col("study_id").alias("Test_Date_dt")))
        doc = F.when(F.col("report_id") % 5 == 0, F.lit('{"records": []}')).otherwise(F.concat(F.lit('{"records": ['), rec, F.lit(","), rec, F.lit("]}")))
        return r.select("row_ord", doc.alias("analysis_data"))

    fields = ", ".join(f'"{c}"' for c in RECORD_TEXT_FIELDS)
    query("a09_document_scan", f"""SELECT row_ord, CAST(NULL AS INTEGER) AS pos, {", ".join(f'NULL AS "{c}"' for c in RECORD_TEXT_FIELDS)}, NULL AS "Aliases", NULL AS "Processed_Date", CAST(NULL AS DOUBLE) AS "Result_Numeric", NULL AS "Test_Date_dt"
      FROM lab_records WHERE report_id % 5 = 0 UNION ALL
      SELECT row_ord, CAST(p AS INTEGER), {fields}, "Original_Test_Name" || '|' || "Lab_Name", '2024-05-06', CAST(report_id AS DOUBLE), study_id FROM lab_records, (VALUES (0), (1)) v(p) WHERE report_id % 5 > 0""", L)(
        lambda s, f: pay.document_records(documents(s, f)).withColumn("Aliases", F.when(F.col("Aliases").isNotNull(), F.array_join("Aliases", "|"))))
    query("a10_history_scan", "SELECT row_ord FROM checked WHERE k <> 3", "checked")(lambda s, f: pay.history_snapshots(report_payloads(s, f), "payload").select("row_ord"))
    SQL.add("texts", "SELECT doc_id, left(text, 2000) AS preview, md5(text) AS content_key FROM documents")
    query("a11_report_texts", "SELECT * FROM texts", "texts")(lambda s, f: pay.text_table(table(s, f, "documents")).select("doc_id", "preview", "content_key"))
    query("a11_first_by_content_key", "SELECT content_key, min(doc_id) AS doc_id, count(*) AS copies FROM texts GROUP BY 1", "texts")(
        lambda s, f: pay.first_by_key(pay.text_table(table(s, f, "documents")), "doc_id"))

    def folder(s, f):
        path = scratch_path(s, "folder")
        r = report_payloads(s, f)
        r.select("payload").write.text(path)
        texts = s.read.text(path).withColumnRenamed("value", "payload").withColumn("file_name", F.lit("batch.pdf"))
        rows = pay.record_rows(pay.validate_payloads(texts), F.col("file_name"), [])
        out = scratch_path(s, "cleaned-csv")
        sinks.write_records_csv(rows.select("Source_Filename", "Test_Name", "Test_Date", "Test_Category", "Patient_ID", "Result", "Status"), out)
        return his.read_csv(s, out).groupBy("Source_Filename", "Test_Name", "Status").agg(n_rows().alias("n"))

    query("a12_folder_batch", f"""SELECT 'batch.pdf' AS "Source_Filename", n.name AS "Test_Name", {d.canonical_status('r."Status"')} AS "Status", count(*) AS n FROM checked r JOIN rec_name n ON n.raw = r."Original_Test_Name" WHERE k NOT IN (3, 4) GROUP BY ALL""", "checked", "rec_name")(folder)

    def append_twice(s, f):
        path = scratch_path(s, "reports")
        r = lab_records(s, f).select("report_id", "study_id", "row_ord", (F.col("report_id") % 2).cast("int").alias("normalization_version"))
        for half in (0, 1):
            sinks.append_reports(r.where(F.floor(F.col("report_id") % 4 / 2) == half), path)
        return s.read.parquet(path).groupBy("normalization_version").agg(n_rows().alias("n"))

    query("a13_append_reports", "SELECT CAST(report_id % 2 AS INTEGER) AS normalization_version, count(*) AS n FROM lab_records GROUP BY 1", L)(append_twice)

    def history_sink(s, f):
        path = scratch_path(s, "history")
        o = table(s, f, "orders")
        sinks.append_history(o.select("o_orderkey", F.struct(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("t")).alias("analysis"), F.array(F.lit("a.pdf"), F.lit("b.pdf")).alias("source_filenames")), path)
        h = s.read.parquet(path)
        return h.select("o_orderkey", F.get_json_object("analysis_json", "$.p").alias("p"), F.element_at(F.split("source_filenames", ","), 2).alias("second"))

    query("a14_append_history", "SELECT o_orderkey, o_orderpriority AS p, 'b.pdf' AS second FROM orders")(history_sink)

    def csv_sinks(s, f):
        path = scratch_path(s, "records-csv")
        sinks.write_records_csv(lab_records(s, f).withColumn("Result_Numeric", F.lit(1.0)).withColumn("Aliases", F.array("Test_Name", "Unit")), path)
        back = his.read_csv(s, path)
        assert "Result_Numeric" not in back.columns
        return back.groupBy("Lab_Name").agg(n_rows().alias("n"), F.countDistinct("row_ord").alias("rows"))

    query("a15_csv_sinks", 'SELECT "Lab_Name", count(*) AS n, count(DISTINCT row_ord) AS rows FROM lab_records GROUP BY 1', L)(csv_sinks)
    query("a16_workbook_data", """SELECT c.scope_id, c."Test_Category", c."Test_Name", c.date_lab, c."Result", r."Reference_Range" AS common_range FROM cells c LEFT JOIN common_ref r USING (scope_id, "Test_Category", "Test_Name")""", "cells", "common_ref")(
        lambda s, f: ins.organized_cells(lab_records(s, f)).join(ins.common_ranges(lab_records(s, f)).withColumnRenamed("Reference_Range", "common_range"), ["scope_id", "Test_Category", "Test_Name"], "left"))
    query("a17_print_table", """SELECT row_ord, left("Test_Name", 30) AS "Test_Name", "Result", coalesce("Unit", '') AS "Unit", coalesce("Reference_Range", 'N/A') AS "Reference_Range", coalesce("Status", 'Normal') AS "Status" FROM lab_records""", L)(
        lambda s, f: sinks.print_table(lab_records(s, f)))

    def telemetry(s, f):
        from labtrail.catalog.metrics_view import metrics

        path = scratch_path(s, "metrics")
        sinks.append_metrics(metrics(s, f), path)
        return s.read.parquet(path).groupBy("day", "metric_name").agg(n_rows().alias("n"))

    query("a18_metric_log_sink", "SELECT CAST(created_at AS DATE) AS day, metric_name, count(*) AS n FROM metrics GROUP BY ALL", "metrics")(telemetry)

    def overridden(s, f):
        r = lab_records(s, f)
        known = F.array(st.canonical_status(F.col("Status")), F.lit("High"), F.lit("N/A"))
        model = F.when(F.col("report_id") % 2 == 0, F.lit('[{"index":0,"status":"detected"},{"index":1,"status":"weird"},{"index":2,"status":"low"},{"index":9,"status":"high"},{"index":0,"status":"critical"}]')).otherwise(F.lit("[]"))
        return r.select("row_ord", F.posexplode(pay.override_statuses(known, model)).alias("pos", "status"))

    query("p16_override_statuses", f"""SELECT row_ord, CAST(0 AS INTEGER) AS pos, CASE WHEN report_id % 2 = 0 THEN 'Critical' ELSE {d.canonical_status('"Status"')} END AS status FROM lab_records
      UNION ALL SELECT row_ord, 1, 'High' FROM lab_records UNION ALL SELECT row_ord, 2, CASE WHEN report_id % 2 = 0 THEN 'Low' ELSE 'N/A' END FROM lab_records""", L)(overridden)

    def workflow(s, f):
        from labtrail.catalog.patients import existing, infos
        from labtrail.operators import patients as pt
        from labtrail.operators.records import combine

        old = his.unpivot_history(wide_history(s, f), "x.csv", carry=["scope_id"])
        rows = combine(old, lab_records(s, f).drop("study_id"), "N/A").groupBy("scope_id").agg(n_rows().alias("rows"), F.count_if(F.col("row_ord") == "N/A").alias("from_export"))
        patient = pt.merge_with_existing(existing(s, f), infos(s, f).where("report_id % 3 > 0"))
        return rows.join(patient.select("scope_id", "name", "date"), "scope_id", "left")

    from labtrail.catalog.registry import ORACLES

    query("p15_combine_existing_and_new")(workflow)
    # the patient part of the check is the registered merge check, as a subquery
    merged = ORACLES["e17_merge_existing_patient"]
    ORACLES["p15_combine_existing_and_new"] = SQL.query(
        f"""SELECT a.scope_id, a.n + coalesce(b.n, 0) AS rows, coalesce(b.n, 0) AS from_export, m.name, m.date FROM (SELECT scope_id, count(*) AS n FROM lab_records GROUP BY 1) a
        LEFT JOIN (SELECT scope_id, count(*) AS n FROM wide_cells GROUP BY 1) b USING (scope_id) LEFT JOIN ({merged}) m USING (scope_id)""", L, "wide_cells")
