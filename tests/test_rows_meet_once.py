"""Jobs that ask much of a patient write the rows by patient once; nothing that reads them is shuffled."""

import glob
import time

from labtrail.catalog.views import lab_records
from labtrail.operators import panel as pan
from labtrail.operators import timelines as tl
from labtrail.session import materialize, materialize_by
from tests.test_resolve_shuffles import plan

SF = "/root/testdata/sf0.001"


def test_parts_of_a_prompt_read_findings_by_patient(spark):
    out = tl.prompt_parts(tl.chat_findings(lab_records(spark, SF)))
    assert "Exchange hashpartitioning" not in plan(out) and "Bucketed: true" in plan(out)
    rows = [("p", "2024-01-01", "L", f"n{i}", "c", "1", "", s, None, str(i)) for i, s in enumerate(["HIGH", "NORMAL", "LOW"])] + [(None, "2024-01-01", "L", "n", "c", "1", "", "HIGH", None, "9")]
    df = spark.createDataFrame(rows, "scope_id string, date string, lab string, name string, canonical string, value string, unit string, severity string, day date, row_ord string")
    told = {r.scope_id: r.abnormal for r in tl.recent_timeline(df).collect()}
    assert told == {"p": "n0: 1 (HIGH), n2: 1 (LOW)", None: "None"}
    assert [tuple(r) for r in tl.persistent_concerns(df).collect()] == [("p", "c", 2)]


def test_a_review_reads_entries_by_patient(spark):
    entries = pan.finding_entries(lab_records(spark, SF))
    assert "Exchange hashpartitioning" not in plan(pan.structured_review(entries))
    by = materialize_by(entries, "entries", "scope_id")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(pan.priority_findings(by, met=True), pan.priority_findings(by)) and same(pan.priority_metrics(by, met=True), pan.priority_metrics(by))


def test_shuffles_go_with_the_write(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in manager.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    made = materialize(spark.range(1000).repartition(3, "id"), "made")
    for _ in range(50):  # they are removed beside the job
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
