"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows

from labtrail.catalog.metrics_view import from_events, grade_sql
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, records_by_report, table
from labtrail.session import scratch_path
from labtrail.streaming import jobs



FILES = 4


def streamed(s, rows, label, dealt=False):
    """Rows as a stream of several micro-batches: dealt to files without order
    by one shuffle, or as they are ``dealt`` already, and a share of the files
    to a batch.  There are as many files as the session has shuffle partitions."""
    path, width = scratch_path(s, label), max(FILES, int(s.conf.get("spark.sql.shuffle.partitions")))
    deal = F.pmod(F.xxhash64(*rows.columns), F.lit(width))
    (rows if dealt else rows.repartition(width, deal)).write.option("compression", "zstd").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-width // FILES)).parquet(path)


def with_repeats(rows):
    """Every tenth row a second time."""
    return rows.union(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(10)) == 0))


def progress_events(o):
    """Each file is parsed and then done or failed; some that failed are tried
    again, and some steps are told twice."""
    k = F.col("o_orderkey")
    at = (k % 997).cast("double")
    steps = F.array(
        F.struct(F.lit("parsing").alias("step"), at.alias("at")),
        F.when(k % 4 > 0, F.struct(F.when(k % 11 == 0, "failed").otherwise("done").alias("step"), (at + 1).alias("at"))),
        F.when((k % 4 > 0) & (k % 33 == 0), F.struct(F.lit("done").alias("step"), (at + 2).alias("at"))),
    )
    e = o.select("o_custkey", "o_orderkey", F.explode(F.array_compact(steps)).alias("e"))
    return with_repeats(e.select(
        (F.col("o_custkey") % 100).alias("batch_id"), F.concat_ws(" ", "o_orderkey", "o_custkey").alias("file"), "e.step", F.lit(2000).cast("long").alias("total"), F.col("e.at").alias("at_seconds")))


def stamped(events):
    return from_events(events).withColumn("created_at", F.col("created_at").cast("timestamp"))


def register() -> None:
    def tracker(s, sf):
        events = streamed(s, progress_events(table(s, sf, "orders")), "progress-events")
        out = jobs.drain_updates(jobs.batch_progress(events), scratch_path(s, "progress"), scratch_path(s, "cp"))
        # the totals come out of the stream; of each batch the last ones are shown
        newest = out.groupBy("batch_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("batch_id", "_batch")]), "_batch").alias("r"))
        return newest.select("batch_id", "r.*").drop("stalled")

    SQL.add("file_steps", """SELECT DISTINCT o_custkey % 100 AS batch_id, o_orderkey || ' ' || o_custkey AS file, o_orderkey % 4 > 0 AS closed, o_orderkey % 4 > 0 AND o_orderkey % 11 = 0 AND o_orderkey % 33 > 0 AS failed,
      CAST(o_orderkey % 997 AS DOUBLE) + CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 33 = 0 THEN 2 ELSE 1 END AS at_s FROM orders""")
    query("t01_progress_tracker", """SELECT batch_id, processed, failed, total, elapsed, CAST(CASE WHEN processed > 0 THEN floor(elapsed / processed * greatest(total - processed, 0)) ELSE 0 END AS BIGINT) AS eta_seconds,
      CAST(floor(processed / total * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT batch_id, count(*) FILTER (WHERE closed) AS processed, count(*) FILTER (WHERE failed) AS failed,
      CAST(2000 AS BIGINT) AS total, max(at_s) AS elapsed FROM file_steps GROUP BY 1)""", "file_steps")(tracker)

    # update mode emits every window, also those the watermark keeps open
    def rollup(s, sf):
        # files without order are as late as the table is long
        m = jobs.metric_windows(stamped(streamed(s, table(s, sf, "events"), "events")), late="60 days")
        out = jobs.drain_updates(m, scratch_path(s, "rollup"), scratch_path(s, "cp"))
        last = out.groupBy("metric_name", "start").agg(F.max_by(F.struct("events", "value", "grade"), "_batch").alias("r"))
        return last.select("metric_name", F.to_date("start").alias("day"), F.col("r.events").alias("events"), F.round("r.value", 6).alias("value"), F.col("r.grade").alias("grade"))

    daily = f"SELECT metric_name, day, events, round(value, 6) AS value, {grade_sql('metric_name', 'value')} AS grade FROM (SELECT metric_name, CAST(created_at AS DATE) AS day, count(*) AS events, avg(value) AS value FROM metrics GROUP BY 1, 2)"
    query("t02_metric_rollup", daily, "metrics")(rollup)
    def sliding(s, sf):
        m = jobs.metric_windows(stamped(streamed(s, table(s, sf, "events"), "events")), "7 days", "1 day", "60 days")
        out = jobs.drain_updates(m, scratch_path(s, "sliding"), scratch_path(s, "cp"))
        last = out.groupBy("metric_name", "start").agg(F.max_by("events", "_batch").alias("events"))
        return last.groupBy("metric_name").agg(n_rows().alias("windows"), F.sum("events").alias("events"))

    query("t02_sliding_week", "SELECT metric_name, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM (SELECT metric_name, CAST(created_at AS DATE) + CAST(o AS INTEGER) AS w, count(*) AS n FROM metrics, range(0, 7) r(o) GROUP BY 1, 2) GROUP BY 1", "metrics")(sliding)

    def memory(s, sf):
        out = jobs.drain_updates(jobs.session_memory(streamed(s, table(s, sf, "conversations"), "turns"), 6, None), scratch_path(s, "memory"), scratch_path(s, "cp"))
        newest = out.groupBy("conv_id").agg(F.max("_batch").alias("_batch"))
        return out.join(newest, ["conv_id", "_batch"]).select("conv_id", "turn", "role")

    query("t03_session_memory", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")(memory)

    def arrivals(s, sf):
        out = scratch_path(s, "normalized")
        # dealt by report while the rows are narrow
        rows = records_by_report(s, sf).drop("first_day").withColumn("normalization_version", (F.col("report_id") % 3 == 0).cast("int"))
        q = jobs.normalize_arrivals(streamed(s, rows, "arrivals", dealt=True), out, scratch_path(s, "cp"), ["study_id", "report_id"])
        q.awaitTermination()
        return s.read.parquet(out).select("study_id", "report_id", "row_ord", "Test_Name", "Test_Category")

    query("t04_incremental_normalization", '''SELECT study_id, report_id, row_ord, "Test_Name", "Test_Category" FROM rep WHERE report_id % 3 > 0
      UNION ALL SELECT study_id, report_id, row_ord, "Test_Name", "Test_Category" FROM lab_records WHERE report_id % 3 = 0''', "rep", "lab_records")(arrivals)

    def intake(s, sf):
        texts = with_repeats(table(s, sf, "documents").select("doc_id", "text"))
        path = scratch_path(s, "intake")
        q = jobs.take_in(streamed(s, texts, "arriving-texts"), path, scratch_path(s, "cp"))
        q.awaitTermination()
        return s.read.parquet(path).groupBy("content_key").agg(n_rows().alias("taken"))

    query("t05_report_intake", "SELECT DISTINCT md5(text) AS content_key, CAST(1 AS BIGINT) AS taken FROM documents")(intake)
