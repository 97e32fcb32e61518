"""Findings parse names, statuses, dates and ranges once per spelling, not on every row of every pass."""

from pyspark.sql import functions as F

from labtrail.catalog.views import lab_records
from labtrail.operators import chat as ch
from labtrail.operators import panel as pan
from labtrail.operators import timelines as tl

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_findings_carry_no_date_or_name_patterns(spark):
    records = lab_records(spark, SF)
    assert not [w for w in ("regexp", "gettimestamp", "rlike") if w in plan(tl.chat_findings(records))]
    assert "gettimestamp" not in plan(pan.finding_entries(records))


def test_odd_spellings_of_findings(spark):
    rows = [("p", "1", None, " ", None, None, " ", None, None), ("p", "2", " TSH ", "x", "2024-02-30", "L", "1", None, "High"), ("p", "3", "", "y", "2024-02-03", None, None, "mg", " ")]
    df = spark.createDataFrame(rows, "scope_id string, row_ord string, Test_Name string, Original_Test_Name string, Test_Date string, Lab_Name string, Result string, Unit string, Status string")
    got = {r.row_ord: r for r in tl.chat_findings(df).collect()}
    assert len(got) == 3 and [got[k].name for k in "123"] == ["Unknown test", "TSH", "Unknown test"]
    assert [got[k].date for k in "123"] == ["Unknown date", "2024-02-30", "2024-02-03"] and str(got["3"].day) == "2024-02-03"


def test_context_groups_findings_of_those_who_ask(spark):
    from labtrail.operators import guidelines as gl

    findings = tl.chat_findings(lab_records(spark, SF))
    scopes = [r[0] for r in findings.select("scope_id").distinct().orderBy("scope_id").limit(2).collect()]
    turns = spark.createDataFrame([(scopes[0], 1, 1, "user", "my sugar is high"), (scopes[1], 2, 1, "assistant", "ok")], "scope_id string, conv_id long, turn long, role string, text string")
    out = ch.chat_context(findings, turns, gl.knowledge(spark), F.lit("2024-06-01").cast("date"))
    assert [r.scope_id for r in out.collect()] == [scopes[0]] and "leftsemi" in plan(out)
    whole = tl.prompt_parts(findings).where(F.col("scope_id") == scopes[0]).first()
    assert out.select(*whole.asDict()).first() == whole
