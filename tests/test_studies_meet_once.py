"""A combined report shuffles the content of its studies once."""

from labtrail.catalog.accounts import jobs
from labtrail.catalog.records import report_files
from labtrail.catalog.views import lab_records
from labtrail.operators.resolve import resolve_records
from tests.test_resolve_shuffles import plan

SF = "/root/testdata/sf0.001"


def test_content_of_studies_is_read_by_study(spark):
    r = lab_records(spark, SF)
    out = jobs.combined_reports(resolve_records(r.where("report_id % 2 = 0"), jobs.REPORT), r.where("report_id % 2 = 1"), report_files(spark, SF))
    # the studies that are resolved again are the only shuffle: one key a study
    assert "Bucketed: true" in plan(out) and "Exchange hashpartitioning(study_id" not in plan(out.select("row_ord", "Test_Name")).replace("Exchange hashpartitioning(study_id", "", 2)
    assert "_cluster" not in "".join(x for x in plan(out).splitlines() if "Exchange hashpartitioning" in x)
