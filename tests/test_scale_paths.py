"""Paths that only large groups take, checked on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from labtrail.operators import dictionary as di
from labtrail.operators import panel as pan
from labtrail.operators import patients as pt


def match(a, b):
    x, y = set(a.split()), set(b.split())
    return x <= y or y <= x or (len(x & y) >= 2 and len(x & y) / len(x | y) >= 0.6)


def test_name_conflicts_with_many_names(spark):
    many = [f"Asha {a}{b}" for a, b in itertools.product("Bcdefghijk", "abcdefgh")]
    rows = [("big", f"{i:03d}", n.title()) for i, n in enumerate(["Asha"] + many)]
    rows += [("few", "000", "Mr. Ravi Kumar"), ("few", "001", "Ravi"), ("few", "002", "Zed Other"), ("same", "000", "Li"), ("same", "001", "Dr Li")]
    want = {}
    for scope in ("big", "few", "same"):
        names = [r for r in rows if r[0] == scope]
        clean = [n[2].replace("Mr. ", "").replace("Dr ", "") for n in names]
        for i, j in itertools.combinations(range(len(names)), 2):
            if not match(clean[i], clean[j]):
                want[scope] = (names[i][2], names[j][2])
                break
    infos = spark.createDataFrame(rows, "scope_id string, row_ord string, name string")
    got = {r[0]: (r[1], r[2]) for r in pt.name_conflicts(infos).collect()}
    assert got == want


def test_name_conflicts_of_random_scopes(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for s in range(40):
        words = [f"w{s}{k}".replace("0", "a") for k in range(rng.choice([3, 5, 9]))]
        core = words[: rng.choice([0, 1, 3])]
        names = list(dict.fromkeys(" ".join(sorted(set(core + rng.sample(words, rng.randint(1, 3))))) for _ in range(rng.randint(1, 12))))
        rows += [(str(s), f"{i:03d}", n) for i, n in enumerate(names)]
        pairs = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if not match(names[i], names[j])]
        if pairs:
            want[str(s)] = (names[pairs[0][0]], names[pairs[0][1]])
    infos = spark.createDataFrame(rows, "scope_id string, row_ord string, name string")
    assert {r[0]: (r[1], r[2]) for r in pt.name_conflicts(infos).collect()} == want and 5 < len(want) < 40


def test_few_names_are_compared(spark):
    names = spark.createDataFrame([("s", "asha " + "".join(p)) for p in itertools.product("bcdefgh", repeat=3)] + [("s", "asha")], "scope_id string, norm string")
    rows = {r.norm: r for r in pt.clash_bounds(names).collect()}
    # the name that is part of all others may match them; each other one matches few
    assert rows["asha"].like >= 344 and all(r.like < 10 for n, r in rows.items() if n != "asha")


def test_dictionary_join_beyond_the_broadcast_limit(spark):
    df = spark.range(2000).select((F.col("id") % 50).cast("string").alias("t")).withColumn("t", F.when(F.col("t") != "7", F.col("t")))
    answers = {"u": F.concat(F.col("_key"), F.lit("!"))}
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    small = di.with_derived(df, {"t": answers})
    rows = sorted(map(str, small.collect()))
    assert "BroadcastHashJoin" in plan(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        large = di.with_derived(df, {"t": answers})
        assert "BroadcastHashJoin" not in plan(large) and sorted(map(str, large.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_streaks_against_a_plain_loop(spark):
    rnd = random.Random(5)
    rows = [(str(rnd.randrange(3)), f"{i:04d}", rnd.choice("xyz"), rnd.choice(["NORMAL", "HIGH", "BORDERLINE"]), rnd.randrange(6)) for i in range(300)]
    df = spark.createDataFrame(rows, "scope_id string, row_ord string, test_name string, severity string, d int").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    want = {}
    for key in {(r[0], r[2]) for r in rows}:
        group = sorted((r for r in rows if (r[0], r[2]) == key), key=lambda r: (-r[4], r[1]))
        run = len(list(itertools.takewhile(lambda r: r[3] != "NORMAL", group)))
        if run:
            want[key] = run
    got = {(r[0], r[1]): r[2] for r in pan.abnormal_streaks(df).collect()}
    assert got == want


def test_unpivot_of_pivot_is_the_first_value_per_cell(spark):
    from labtrail.catalog.insights import YEAR_LABS, yearly
    from labtrail.operators import insights as ins
    from labtrail.sources.history import unpivot_history

    cells = ins.organized_cells(yearly(spark, "/root/testdata/sf0.001"))
    wide = ins.organized_table(cells, YEAR_LABS)
    assert unpivot_history(wide, "x.csv", carry=["scope_id"]).count() == cells.count()


def test_totals_hold(spark):
    from labtrail.catalog.views import lab_records
    from labtrail.operators import insights as ins
    from labtrail.operators.resolve import normalize_records, resolve_records

    raw = lab_records(spark, "/root/testdata/sf0.001")
    n = normalize_records(raw)
    assert ins.category_scores(n).agg(F.sum("total_tests")).first()[0] == raw.count()
    assert ins.body_systems(n).where("abnormal_ratio < 0 OR abnormal_ratio > 1").count() == 0
    date = F.coalesce(F.nullif(F.trim("Test_Date"), F.lit("")), F.lit("N/A"))
    assert resolve_records(raw).count() == n.select("scope_id", "_cluster", date).distinct().count()


def test_exact_percentile(spark):
    import numpy as np

    from labtrail.operators.quality import exact_percentile

    rng = np.random.default_rng(2)
    sets = {"a": rng.normal(size=20_001), "b": rng.integers(0, 3, 5000).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in sets.items() for x in v] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.p for r in exact_percentile(df, "k", "v", share).collect()}
        assert set(got) == set(sets)
        assert {k: got[k] for k in sets} == {k: pytest.approx(float(np.quantile(v, share)), abs=1e-12) for k, v in sets.items()}, share
