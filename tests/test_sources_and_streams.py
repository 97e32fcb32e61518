"""Readers and streaming jobs on small inputs that older code got wrong."""

import csv
import time

from pyspark.sql import functions as F

from labtrail.operators import quality as qu
from labtrail.session import scratch_path
from labtrail.sources import history as his
from labtrail.sources import payloads as pay
from labtrail.streaming import jobs


def test_progress_counts_files_not_events(spark):
    events = [("x", "a", "parsing", 2, 1.0), ("x", "a", "done", 2, 2.0), ("x", "a", "done", 2, 2.0), ("x", "b", "failed", 2, 3.0), ("x", "b", "parsing", 2, 1.0)]
    df = spark.createDataFrame(events, "batch_id string, file string, step string, total long, at_seconds double")
    r = jobs.progress(jobs.latest_steps(df)).first()
    assert (r.processed, r.failed, r.percent, r.eta_seconds) == (2, 1, 100, 0)
    again = df.union(spark.createDataFrame([("x", "b", "done", 2, 4.0)], df.schema))
    assert jobs.progress(jobs.latest_steps(again)).first().failed == 0


def test_progress_as_a_stream_equals_the_batch(spark):
    path = scratch_path(spark, "events")
    rows = [("x", f"f{k % 7}", ["parsing", "done", "failed"][k % 3], 9, float(k * 5 % 11)) for k in range(40)]
    schema = "batch_id string, file string, step string, total long, at_seconds double"
    for part in range(4):
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.drain_updates(jobs.latest_steps(stream), scratch_path(spark, "out"), scratch_path(spark, "cp"))
    newest = out.groupBy("batch_id", "file").agg(F.max_by(F.struct("step", "total", "at_seconds"), "_batch").alias("r")).select("batch_id", "file", "r.*")
    assert jobs.progress(newest).collect() == jobs.progress(jobs.latest_steps(spark.createDataFrame(rows, schema))).collect()


def test_intake_remembers_all_batches(spark):
    path, source, cp = (scratch_path(spark, x) for x in ("taken", "texts", "cp"))
    long = "x" * 130_000

    def arrive(*rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        jobs.take_in(stream, path, cp).awaitTermination()

    arrive((1, "a"), (2, "a"), (3, long + "one"))
    arrive((4, "a"), (5, long + "two"))
    arrive((6, long + "one"), (7, "b"))
    kept = spark.read.parquet(path).select("text").collect()
    assert sorted(r.text[-3:] for r in kept) == ["a", "b", "one", "two"]


def test_content_key_covers_the_whole_text(spark):
    df = spark.createDataFrame([("x" * 125_000 + "1",), ("x" * 125_000 + "2",)], "text string")
    assert pay.text_table(df).select("content_key").distinct().count() == 2
    assert pay.text_table(df, key_chars=120_000).select("content_key").distinct().count() == 1


def test_stacked_files_with_columns_of_their_own(spark):
    path = scratch_path(spark, "stacked")
    for dates, labs, rows in (
        (["01-02-2024", "Reference Ranges"], ["City, Lab", ""], [["Blood", "Hb", "13", "12-16"], ["Blood", "ESR", "", "<20"]]),
        (["03-04-2024", "05-06-2024", "Reference Ranges"], ["One", "", ""], [["Lipid", 'LDL "c"', "100", "110", ""]]),
    ):
        cell = lambda x: '"' + x.replace('"', '""') + '"'
        lines = [["title"], ["Date", "", *dates], ["Lab", "", *labs], [""], *rows]
        text = [",".join(map(cell, line)) for line in lines]
        spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.mode("append").text(path)
    got = sorted((r.Test_Category, r.Test_Name, r.Test_Date, r.Lab_Name, r.Result, r.Reference_Range) for r in his.read_stacked_files(spark, path).collect())
    assert got == [
        ("Blood", "Hb", "01-02-2024", "City, Lab", "13", "12-16"), ("Lipid", 'LDL "c"', "03-04-2024", "One", "100", "N/A"), ("Lipid", 'LDL "c"', "05-06-2024", "Lab", "110", "N/A"),
    ]


def test_stacked_files_are_read_by_partitions_of_files(spark, tmp_path):
    from labtrail.sources import stacked

    def export(name, dates, labs, rows):
        text = "\n".join([",title", ",Date," + ",".join(dates), ",Lab," + ",".join(labs), "", *rows])
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, "utf-8-sig")

    export("a.csv", ["01-02-2024"], ["L1"], [f"Blood,T{k},{k}" for k in range(25_000)])
    export("deep/b.csv", ["col", "2024", "Reference"], ["7", "nan", ""], ['Lipid,"LDL\nserum",9,100,< 90', ",x,1,None,", "short", "", "Lipid,test_name,1,2,3"])
    export("only_title.csv", [], [], [])
    export("_hidden.csv", ["d"], ["l"], ["a,b,c"])
    (tmp_path / "in" / "empty.csv").write_text("")
    df = his.read_stacked_files(spark, str(tmp_path / "in"))
    rows = df.where("Source_Filename <> 'a.csv'").collect()
    assert [tuple(r) for r in rows] == [("b.csv", "Lipid", "LDL\nserum", "2024", "Lab", "100", "< 90")]
    assert df.where("Source_Filename = 'a.csv'").agg(F.sum("Result").cast("long")).first()[0] == sum(range(25_000))
    one_each = spark.read.format("stacked_headers").option("partition_bytes", 1).load(str(tmp_path / "in"))
    assert one_each.rdd.getNumPartitions() == 4 and df.rdd.getNumPartitions() == 1 and one_each.count() == 25_001
    assert his.read_stacked_files(spark, f"file://{tmp_path}/in/deep/b.csv").count() == 1
    assert [f for f, _ in stacked.list_files(str(tmp_path / "in" / "a.csv"))] == [str(tmp_path / "in" / "a.csv")]


def test_stored_records_keep_all_fields(spark):
    doc = '{"records": [{"Test_Name": "Hb", "Lab_Name": "L", "Patient_ID": "7", "Aliases": ["a", "b"], "Result_Numeric": 1.5}]}'
    r = pay.document_records(spark.createDataFrame([(1, doc)], "id long, analysis_data string")).first()
    assert (r.Lab_Name, r.Patient_ID, r.Aliases, r.Result_Numeric, r.Unit) == ("L", "7", ["a", "b"], 1.5, None)


def test_findings_of_reports_without_text_are_told_apart(spark):
    findings = spark.createDataFrame([(1, 5.0, "5"), (1, 7.0, "7"), (2, 5.0, "5")], "report_id long, value double, shown string")
    texts = spark.createDataFrame([(1, "value 5 here")], "report_id long, text string")
    got = sorted((r.report_id, r.value, r.reason) for r in qu.unsupported_values(findings, texts).collect())
    assert got == [(1, 7.0, "not in text"), (2, 5.0, "no text")]


PROGRESS_EVENTS = "batch_id long, file string, step string, total long, at_seconds double"


def test_batch_totals_come_out_of_the_stream(spark):
    path = scratch_path(spark, "progress-in")
    # late, repeated and repaired steps, in several micro-batches
    rows = [(k % 2, f"f{k % 7}", ["parsing", "done", "failed", "done"][k % 4], 9, float(k * 5 % 23)) for k in range(60)] + [(0, "f1", "done", 9, 99.0)] * 2
    for part in range(3):
        spark.createDataFrame(rows[part::3], PROGRESS_EVENTS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(PROGRESS_EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.drain_updates(jobs.batch_progress(stream), scratch_path(spark, "out"), scratch_path(spark, "cp"))
    last = out.groupBy("batch_id").agg(F.max_by(F.struct("processed", "failed", "total", "elapsed", "eta_seconds", "percent"), "_batch").alias("r")).select("batch_id", "r.*")
    want = jobs.progress(jobs.latest_steps(spark.createDataFrame(rows, PROGRESS_EVENTS))).select(last.columns)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and out.where("stalled").count() == 0


def test_a_silent_batch_is_told_as_stalled(spark):
    path, out = scratch_path(spark, "silent"), scratch_path(spark, "silent-out")
    rows = [(1, "a", "done", 2, 1.0), (1, "b", "parsing", 2, 2.0), (2, "a", "done", 1, 1.0)]
    spark.createDataFrame(rows, PROGRESS_EVENTS).coalesce(1).write.parquet(path)
    stream = jobs.batch_progress(spark.readStream.schema(PROGRESS_EVENTS).parquet(path), idle_ms=1000)
    query = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/b{n}")).outputMode("update")
    query = query.option("checkpointLocation", scratch_path(spark, "cp")).trigger(processingTime="500 milliseconds").start()
    deadline = time.time() + 60
    stalled = []
    while time.time() < deadline and not stalled:
        time.sleep(1)
        if query.lastProgress and query.lastProgress["batchId"] >= 1:
            found = spark.read.schema(jobs.PROGRESS).option("recursiveFileLookup", True).parquet(out)
            stalled = [(r.batch_id, r.processed) for r in found.where("stalled").collect()]
    query.stop()
    # the second batch was complete, so it is only forgotten
    assert stalled == [(1, 1)]


def test_session_memory_of_late_and_repeated_turns(spark):
    path = scratch_path(spark, "turns")
    turns = [(1, k, "user", f"t{k}") for k in range(10)]
    arrive = [turns[:4] + turns[6:8], turns[2:5], [(2, 0, "user", None)], turns[8:] + turns[5:6] + turns[:1]]
    for rows in arrive:
        spark.createDataFrame(rows, jobs.TURN).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(jobs.TURN).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.drain_updates(jobs.session_memory(stream, 6, None), scratch_path(spark, "out"), scratch_path(spark, "cp"))
    newest = out.groupBy("conv_id").agg(F.max("_batch").alias("_batch"))
    got = sorted((r.conv_id, r.turn, r.text) for r in out.join(newest, ["conv_id", "_batch"]).collect())
    assert got == [(1, k, f"t{k}") for k in range(4, 10)] + [(2, 0, None)]


def test_a_folder_of_reports_becomes_one_sorted_table(spark, tmp_path):
    from labtrail.sources import sinks

    folder = tmp_path / "reports"
    (folder / "deep").mkdir(parents=True)
    for name in ("a.pdf", "deep/B.PDF", "c.txt", "unread.pdf"):
        (folder / name).write_bytes(b"x")
    manifest = sinks.folder_manifest(spark, str(folder))
    assert sorted(r.file_name for r in manifest.collect()) == ["B.PDF", "a.pdf", "unread.pdf"]
    test = lambda n, r: f'{{"test_name": "{n}", "result": "{r}", "category": "Lipid Profile"}}'
    doc = lambda pid, *tests: f'{{"patient_info": {{"patient_id": "{pid}", "date": "01-02-2024"}}, "test_results": [{", ".join(tests)}]}}'
    rows = [("a.pdf", doc("p2", *[test(f"T{k % 37}", k) for k in range(300)])), ("B.PDF", doc("p1", test("T5", "x"), test("HDL", "50"))), ("c.txt", doc("p", test("T1", "1"))), ("unread.pdf", "{broken")]
    found, files = sinks.folder_batch(manifest, spark.createDataFrame(rows, "file_name string, payload string"))
    assert {r.file_name: (r.rows, r.skipped) for r in files.collect()} == {"a.pdf": (300, False), "B.PDF": (2, False), "unread.pdf": (0, True)}
    out = tmp_path / "csv"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_sorted_csv(found, str(out))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(out.glob("part-*.csv"))
    lines = [line for p in parts for line in csv.DictReader(p.open())]
    keys = [(x["Test_Name"], x["Test_Date"], x["Test_Category"], x["Patient_ID"]) for x in lines]
    assert len(parts) > 1 and len(keys) == 302 and keys == sorted(keys)


def test_a_migration_run_again_replaces_its_own_partitions(spark, tmp_path):
    from labtrail.plans import migration as mig

    doc = '{"records": [{"Test_Name": "haemoglobin a1c", "Original_Test_Name": "haemoglobin a1c", "Result": "5", "Test_Date": "01-02-2024"}], "total_records": 1}'
    rows = [("s", 1, 0, doc), ("s", 2, None, "[1]"), ("s", 3, 1, doc)]
    reports = spark.createDataFrame(rows, "study_id string, report_id long, normalization_version int, analysis_data string")
    line = ("x", "n", "1", "g", "p", "d", "l", 9)
    schema = "id string, patient_name string, patient_age string, patient_gender string, patient_id string, report_date string, lab_name string, total_records long, analysis_json string"
    history = spark.createDataFrame([(*line, doc), ("y", *line[1:], "{no")], schema)
    path = str(tmp_path / "migrated")
    for _ in range(2):
        counts = mig.migrate(reports, history, path)
        assert counts == {"reports": {"updated": 2, "unchanged": 0}, "history": {"updated": 1, "unchanged": 0, "skipped": 1}}
        mig.write_counted(mig.migrate_reports(reports.where("report_id = 3"), 2), f"{path}/reports", {"updated": F.col("updated")}, ["normalization_version", "source_version"])
    got = sorted((r.normalization_version, r.source_version, r.report_id, r.total_records) for r in spark.read.parquet(f"{path}/reports").collect())
    assert got == [(1, 0, 1, 1), (1, 0, 2, 0), (2, 1, 3, 1)]
    assert {r.id: (r.total_records, r.patient_name) for r in spark.read.parquet(f"{path}/history").collect()} == {"x": (1, "n"), "y": (9, "n")}
