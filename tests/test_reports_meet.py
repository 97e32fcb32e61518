"""Rows that are made to documents or dealt by report are shuffled while they are narrow."""

from labtrail.catalog.views import lab_records, records_by_report
from tests.test_resolve_shuffles import plan

SF = "/root/testdata/sf0.001"


def test_reports_meet_while_narrow(spark):
    rows = records_by_report(spark, SF)
    out = plan(rows.groupBy("study_id", "report_id").agg({"row_ord": "collect_list"}))
    assert out.count("hashpartitioning(study_id") == 1
    # what is shuffled are lines, texts are made of them afterwards
    assert "Vitamin B-12" not in plan(rows).split("hashpartitioning(study_id")[1] and "Vitamin B-12" in plan(rows)
    same = lambda df: sorted(map(str, df.where("report_id % 50 = 0").collect()))
    assert same(rows.drop("first_day")) == same(lab_records(spark, SF))
