"""Duplicate resolution shuffles a row once, and only the columns that are read."""

import random

from pyspark.sql import functions as F

from labtrail.operators.resolve import deduplicate, merge_readings, normalize_records

COLS = "scope_id string, row_ord string, Test_Name string, Test_Category string, Test_Date string, Result string, Unit string, Reference_Range string, Status string, Lab_Name string"


def rows(n=400):
    rnd = random.Random(3)
    names, cats = ["TSH", "tsh", "HbA1C", "haemoglobin a1c", "Zinc", " zinc "], ["Thyroid", "Diabetes", "Other", None, "Lipid", "Liver"]
    # one test of one patient has most of the rows
    pick = lambda i: ("hot", "TSH") if i % 3 else (str(rnd.randrange(3)), rnd.choice(names))
    return [(*pick(i)[:1], f"{i:04d}", pick(i)[1], rnd.choice(cats), f"2024-01-{rnd.randrange(1, 28):02d}", rnd.choice(["1", "2.5", "trace"]), rnd.choice(["", "mg"]), rnd.choice(["", "1 - 2"]), rnd.choice([None, "High"]), "lab") for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_once(spark):
    normalized = normalize_records(spark.createDataFrame(rows(), COLS))
    out = plan(deduplicate(normalized))
    assert out.count("Exchange hashpartitioning") == 1
    # the laboratory is carried only when it is read
    assert "Lab_Name" in out and "Lab_Name" not in plan(deduplicate(normalized).select("scope_id", "Status")).split("Exchange hashpartitioning")[0]


def test_readings_carry_what_is_read(spark):
    normalized = normalize_records(spark.createDataFrame(rows(), COLS))
    out = plan(merge_readings(normalized, ["scope_id", "_cluster"]).select("row_ord"))
    assert "Lab_Name" not in out.split("Exchange hashpartitioning")[0] and "SortAggregate" not in out


def test_facts_of_a_large_group(spark):
    normalized = normalize_records(spark.createDataFrame(rows(), COLS)).cache()
    got = {(r.scope_id, r._cluster): r for r in deduplicate(normalized).collect()}
    groups = {}
    for r in sorted(normalized.collect(), key=lambda r: r.row_ord):
        groups.setdefault((r.scope_id, r._cluster), []).append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        best = min(members, key=lambda r: (-r._name_score, r.row_ord))
        aliases = list(dict.fromkeys([a for r in members for a in r.Aliases] + [best.Test_Name]))
        assert (got[key].Test_Name, list(got[key].Aliases)) == (best.Test_Name, aliases)
    assert deduplicate(normalized).groupBy("scope_id", "_cluster", "Test_Date").count().where(F.col("count") > 1).isEmpty()


def test_rows_without_a_scope_belong_to_none(spark):
    odd = [(None, *rows(1)[0][1:]), *rows(2)]
    assert {r[0] for r in deduplicate(normalize_records(spark.createDataFrame(odd, COLS))).select("scope_id").collect()} == {r[0] for r in rows(2)}


def test_best_category_and_first_row_in_one_shuffle(spark):
    from labtrail.operators.records import combine_duplicate_tests, slice_by_file

    # A has two dates, B more rows; a missing date counts as none, a missing name has no category
    cells = [("s", "T", "d1", "A", "1"), ("s", "T", "d2", "A", "2"), ("s", "T", "d1", "B", "3"), ("s", "T", "d1", "B", "4"), ("s", "T", None, "B", "5"), ("s", "T", "d2", None, "6"), ("s", None, "d1", "A", "7")]
    df = spark.createDataFrame(cells, "scope_id string, Test_Name string, Test_Date string, Test_Category string, row_ord string")
    out = combine_duplicate_tests(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("s", "T", "d1", "A", "1"), ("s", "T", "d2", "A", "2"), ("s", "T", None, "A", "5"), ("s", None, "d1", None, "7")], key=str)
    assert plan(combine_duplicate_tests(df)).count("Exchange hashpartitioning") == 1
    # the rows of a report are joined to it once
    files = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "report_id long, file_name string")
    rows_of = spark.createDataFrame([(1, "a.pdf", "1"), (1, "x.pdf", "2"), (2, "x.pdf", "3")], "report_id long, Source_Filename string, row_ord string")
    kept = slice_by_file(rows_of, files, True)
    assert sorted(r.row_ord for r in kept.collect()) == ["1", "3"] and plan(slice_by_file(rows_of, files, True)).count("Join") == 1
