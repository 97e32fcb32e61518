"""Repeats are left out by rank: columns that nobody reads are not shuffled for it."""

from labtrail.catalog.views import lab_records
from labtrail.operators import unify as un
from tests.test_resolve_shuffles import plan


def test_unread_columns_are_not_shuffled(spark):
    out = un.unify_names(lab_records(spark, "/root/testdata/sf0.001")).select("row_ord", "Test_Name")
    assert "Lab_Name" not in plan(out) and "min_by(struct" not in plan(out)
