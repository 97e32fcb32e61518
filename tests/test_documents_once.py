"""Stored documents are read once, and their rows meet without a shuffle of their own."""

from labtrail.operators.resolve import deduplicate, normalize_records
from labtrail.plans import jobs
from tests.test_resolve_shuffles import COLS, plan, rows

DOC = '{"records": [{"Test_Name": "haemoglobin a1c", "Original_Test_Name": "haemoglobin a1c", "Result": "5", "Test_Date": "01-02-2024"}, null, {"Test_Name": "TSH", "Result": "2"}, {"Test_Name": "tsh", "Result": "2.5"}], "total_records": 3}'


def read_once(spark, df):
    """``df`` with a count of the rows that were read of it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(count, df.schema), seen


def test_rows_that_have_met_stay(spark):
    met = normalize_records(spark.createDataFrame(rows(), COLS).repartition("scope_id"))
    assert plan(deduplicate(met, met=True)).count("Exchange hashpartitioning") == 1
    same = lambda df: sorted(map(str, df.collect()))
    assert same(deduplicate(met, met=True)) == same(deduplicate(met))


def test_stored_reports_are_read_once(spark):
    schema = "study_id string, report_id long, profile_id string, file_name string, report_date date, lab_name string, is_normalized boolean, normalization_version int, normalized_records string, analysis_data string"
    kept = '[{"Test_Name": "TSH", "Original_Test_Name": "tsh", "Result": "2", "Test_Date": "N/A", "Test_Category": "Thyroid Profile"}]'
    given = [("s", 1, "p", "a.pdf", None, "L", True, 1, kept, DOC), ("s", 2, "p", "b.pdf", None, "M", False, 0, None, DOC), ("t", 3, "p", "c.pdf", None, "M", True, 1, "[]", "{}")]
    reports, seen = read_once(spark, spark.createDataFrame(given, schema))
    out = jobs.study_reports(reports, spark.createDataFrame([("p", "P", 1)], "profile_id string, full_name string, owner_id int"))
    assert sorted((r.study_id, r.reports, r.reports_with_data) for r in out["totals"].collect()) == [("s", 2, 2), ("t", 1, 0)]
    assert {r.study_id: (r.name, r.lab_name) for r in out["patients"].collect()} == {"s": ("P", "L"), "t": ("P", "M")}
    assert out["overall"].count() == 1 and seen.value == len(given)
