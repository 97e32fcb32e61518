"""Reports are saved with one shuffle of their rows: they meet their file, their date and their places by report."""

from labtrail.catalog.records import report_files
from labtrail.catalog.views import lab_records
from labtrail.plans import jobs
from tests.test_resolve_shuffles import plan

SF = "/root/testdata/sf0.001"


def test_saved_reports_are_shuffled_once(spark):
    out = jobs.save_reports(lab_records(spark, SF), report_files(spark, SF))
    assert plan(out).count("Exchange hashpartitioning") == 1  # the joins are broadcast here


def test_date_of_a_saved_report_is_the_first_readable(spark):
    cols = "study_id string, report_id long, row_ord string, Test_Name string, Test_Category string, Test_Date string, Result string, Unit string, Reference_Range string, Status string, Source_Filename string"
    row = lambda study, report, o, day, file: (study, report, o, "TSH", "Thyroid", day, "1", "", "", "High", file)
    rows = spark.createDataFrame([row("s", 1, "1", "N/A", "a.pdf"), row("s", 1, "2", "2024-01-02", "a.pdf"), row("s", 1, "3", "2024-01-01", "a.pdf"), row("s", 1, "0", "2020-01-01", "x.pdf"), row("s", 2, "4", "N/A", "b.pdf"), row(None, 2, "5", "2024-01-01", "b.pdf")], cols)
    files = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "report_id long, file_name string")
    got = {(r.report_id, r.row_ord): str(r.report_date) for r in jobs.save_reports(rows, files).collect()}
    assert got == {(1, "1"): "2024-01-02", (1, "2"): "2024-01-02", (1, "3"): "2024-01-02", (2, "4"): "None"}
