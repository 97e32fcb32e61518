"""Classified statuses are read once a row, not once for every use at every position."""

from pyspark.sql import functions as F

from labtrail.sources import payloads as pay
from tests.test_resolve_shuffles import plan


def test_classifications_are_parsed_once(spark):
    cases = [
        (["High", "Low", "N/A"], '[{"index":0,"status":"N/A"},{"index":1,"status":"x"},{"index":2,"status":"high"}]', ["High", "Low", "High"]),
        (["High", "Low"], '[{"index":0,"status":"low"},{"index":0,"status":"critical"},{"index":1,"status":null},{"status":"low"},{"index":5,"status":"low"}]', ["Critical", "Low"]),
        (["N/A", None], '[{"index":0,"status":null},{"index":1,"status":"positive"}]', ["N/A", "Positive"]),
        (["High"], None, ["High"]), (["High"], "[]", ["High"]), ([], '[{"index":0,"status":"low"}]', []),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, known array<string>, model string, want array<string>")
    out = df.select("i", "want", pay.override_statuses(F.col("known"), F.col("model")).alias("got"))
    assert all(r.got == r.want for r in out.collect())
    assert plan(out).count("from_json") == 1
