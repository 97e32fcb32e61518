"""Tables that cost much to make are read once, and dates of names once a name."""

from labtrail.operators import insights as ins
from labtrail.operators import quality as qu
from tests.test_documents_once import read_once
from tests.test_resolve_shuffles import plan


def test_findings_are_read_once(spark):
    schema = "report_id long, name string, value double, pos string"
    extracted, seen = read_once(spark, spark.createDataFrame([(1, "a", 1.0, "1"), (1, "a", 1.005, "2"), (2, "b", 3.0, "1")], schema))
    truth, known = read_once(spark, spark.createDataFrame([(1, "a", 1.0, "1"), (2, "b", 5.0, "1"), (3, "c", 5.0, "1")], schema))
    got = sorted((r.report_id, r.true_positives, r.false_positives, r.false_negatives) for r in qu.extraction_f1(extracted, truth).collect())
    assert got == [(1, 1, 1, 0), (2, 0, 1, 1), (3, 0, 0, 1)] and (seen.value, known.value) == (3, 3)


def test_dates_of_a_workbook_are_read_once_a_name(spark):
    schema = "scope_id string, row_ord string, Test_Name string, Test_Category string, Test_Date string, Lab_Name string, Result string"
    rows = [("s", "1", "T", "C", "01-02-2024", "L_x", "5"), ("s", "2", "T", "C", "01-01-2024", "Lab B", "6"), ("s", "3", "U", "D", None, None, "x"), ("s", "4", "N/A", "E", "01-01-2020", "L", "1"), ("s", "5", "V", None, "01-01-2021", "L", "1")]
    out = ins.workbook_summary(spark.createDataFrame(rows, schema))
    assert "d/M/yyyy" not in plan(out)
    r = out.first()
    assert (r.categories, r.tests, r.charts, r.date_labs, r.first_date, r.last_date, r.labs) == (2, 2, 1, 3, "Unknown Date", "01-02-2024", "L_x|Lab B|Unknown Lab")


def test_stacked_files_are_made_of_one_table(spark, monkeypatch):
    import __spark_entry__ as entry

    made, cells = [], ins.organized_cells
    monkeypatch.setattr(ins, "organized_cells", lambda *a, **k: made.append(a) or cells(*a, **k))
    assert not entry.queries()["a02_stacked_files"](spark, "/root/testdata/sf0.001").isEmpty()
    assert len(made) == 2
