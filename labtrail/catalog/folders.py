"""Folder batches over the folder of the tables, and the printed report's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.catalog import duck as d
from labtrail.catalog.payloads import report_payloads
from labtrail.catalog.records import normalized
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, pick, sql_list
from labtrail.operators import insights as ins
from labtrail.sources import sinks

#: Files of the folder, and two that aren't in it.
FILES = [f"{t}.parquet" for t in ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier")] + ["lost.parquet", "other.pdf"]
UNNAMED = [f"{t}.parquet" for t in ("embeddings", "pages", "benchmark", "labels", "conversations")]

SQL.add("filed", f"SELECT *, ({sql_list(FILES)})[report_id % {len(FILES)} + 1] AS file_name FROM checked", "checked")
SQL.add("batch_rows", f"""SELECT row_ord, file_name AS "Source_Filename", n.name AS "Test_Name", {d.canonical_status('r."Status"')} AS "Status", "Result" FROM filed r JOIN rec_name n ON n.raw = r."Original_Test_Name"
  WHERE k NOT IN (3, 4) AND file_name NOT IN ('lost.parquet', 'other.pdf')""", "filed", "rec_name")


def batch(s, f):
    texts = report_payloads(s, f).withColumn("file_name", pick(FILES, F.col("report_id") % len(FILES)))
    return sinks.folder_batch(sinks.folder_manifest(s, f, "*.parquet"), texts.select("row_ord", "file_name", "payload"), ["row_ord"])


def register() -> None:
    query("a12_folder_rows", "SELECT * FROM batch_rows", "batch_rows")(lambda s, f: batch(s, f)[0].select("row_ord", "Source_Filename", "Test_Name", "Status", "Result"))
    query("a12_folder_files", f"""SELECT f.file_name, coalesce(n, 0) AS rows, n IS NULL AS skipped FROM (SELECT unnest({sql_list(FILES[:-2] + UNNAMED)}) AS file_name) f
      LEFT JOIN (SELECT "Source_Filename" AS file_name, count(*) AS n FROM batch_rows GROUP BY 1) USING (file_name)""", "batch_rows")(lambda s, f: batch(s, f)[1])
    concerns = lambda s, f: ins.concerns(normalized(s, f))
    query("a17_printed_alerts", """SELECT * REPLACE (upper(severity) AS severity), CAST(row_number() OVER (PARTITION BY scope_id ORDER BY list_position(['critical', 'high', 'low', 'normal'], severity), total_alerts DESC, category) AS INTEGER) AS place FROM alerts""", "alerts")(
        lambda s, f: sinks.printed_alerts(concerns(s, f)))
    cell = lambda c, new: f"coalesce({d.nz(c)}, 'N/A') AS {new}"
    query("a17_printed_category_tests", f"""SELECT scope_id, category, CAST(row_number() OVER (PARTITION BY scope_id, category ORDER BY row_ord) AS INTEGER) AS place, test_name AS test, {cell('result', 'value')}, {cell('reference', 'reference')}, {cell('status', 'status')}, {cell('date', 'date')}
      FROM (SELECT * REPLACE (coalesce({d.nz('category')}, 'Uncategorized') AS category) FROM concerns)""", "concerns")(lambda s, f: sinks.printed_category_tests(concerns(s, f)))
    query("a17_printed_dates", f"""SELECT scope_id, date, total_tests, categories, alerts, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY day DESC NULLS LAST, date) AS INTEGER) AS place FROM
      (SELECT scope_id, coalesce("Test_Date", 'Unknown') AS date, max({d.client_date('"Test_Date"')}) AS day, count(*) AS total_tests, count(DISTINCT coalesce({d.nz('"Test_Category"')}, 'Uncategorized')) AS categories,
       count(*) FILTER (WHERE lower("Status") IN ('high', 'low', 'critical', 'positive')) AS alerts FROM lab_records WHERE "Test_Name" NOT IN ('N/A', '') AND "Result" IS NOT NULL GROUP BY ALL)""", "lab_records")(lambda s, f: sinks.printed_dates(lab_records(s, f)))
