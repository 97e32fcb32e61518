"""A migration reads its documents once and shuffles them whole."""

from pyspark.sql import functions as F

from labtrail.plans import jobs
from labtrail.plans import migration as mig
from tests.test_documents_once import DOC, read_once
from tests.test_resolve_shuffles import plan


def test_documents_are_migrated_in_two_shuffles(spark):
    line = ("n", "1", "g", "p", "d", "l", 9)
    schema = "id string, patient_name string, patient_age string, patient_gender string, patient_id string, report_date string, lab_name string, total_records long, analysis_json string"
    history, seen = read_once(spark, spark.createDataFrame([("x", *line, DOC), ("y", *line, "{no"), ("z", *line, '{"records": [null], "total_records": 0}')], schema))
    out = mig.migrate_history(history)
    assert plan(out).count("Exchange hashpartitioning") == 2
    got = {r.id: (r.updated, r.skipped, r.total_records) for r in out.collect()}
    assert got == {"x": (True, False, 2), "y": (False, True, 9), "z": (False, False, 9)}
    assert seen.value == 3


def test_digest_of_an_array_is_that_of_its_rows(spark):
    df = spark.createDataFrame([(1, DOC), (2, '{"records": [null]}'), (3, "{}")], "k int, doc string").select("k", F.from_json("doc", mig.DOCUMENT).alias("d"))
    flat = df.select("k", F.explode("d.records").alias("r")).where("r IS NOT NULL").select("k", "r.*")
    want = {r.k: (r.n, r.a, r.b) for r in jobs.content_digest(flat, ["k"]).collect()}
    got = {r.k: tuple(r.g) for r in df.select("k", jobs.content_digest_of("d.records").alias("g")).where("g IS NOT NULL").collect()}
    assert got == want and set(got) == {1}
