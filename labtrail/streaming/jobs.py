"""Structured Streaming jobs.  Each has a batch twin over the same logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.functions.basic import n_rows
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from labtrail.functions import status as st
from labtrail.operators.resolve import resolve_records
from labtrail.sources.payloads import content_key
from labtrail.streaming.keys import KeyStore



# --- progress of ingest batches ---------------------------------------------
STEPS = ["queued", "extracting", "parsing", "failed", "done"]
CLOSED = ("done", "failed")


def latest_steps(events: DataFrame) -> DataFrame:
    """Latest step of every file, as state keyed by file: a step that is told
    again, or that arrives after a later one, changes nothing.

    ``events``: (batch_id, file, step, total, at_seconds).  Of two steps at one
    time the one further on counts.
    """
    further = F.array_position(F.array(*[F.lit(x) for x in STEPS]), F.col("step"))
    return events.groupBy("batch_id", "file").agg(
        F.max_by("step", F.struct("at_seconds", further.alias("further"))).alias("step"), F.max("total").alias("total"), F.max("at_seconds").alias("at_seconds")
    )


def progress(files: DataFrame) -> DataFrame:
    """Files done, failed and remaining time per batch, from the latest step of
    every file; ``done`` and ``failed`` close a file."""
    closed = F.col("step").isin(*CLOSED)
    out = files.groupBy("batch_id").agg(
        F.count_if(closed).alias("processed"), F.count_if(F.col("step") == "failed").alias("failed"),
        F.max("total").alias("total"), F.max("at_seconds").alias("elapsed"),
    )
    left = F.greatest(F.col("total") - F.col("processed"), F.lit(0))
    eta = F.when(F.col("processed") > 0, F.floor(F.col("elapsed") / F.col("processed") * left)).otherwise(0)
    return out.withColumn("eta_seconds", eta.cast("bigint")).withColumn(
        "percent", F.floor(F.col("processed") / F.col("total") * 100 + 0.5).cast("bigint")
    )


# --- telemetry roll-up ------------------------------------------------------
def metric_windows(metrics: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling (or sliding) windows per metric; rows later than the watermark
    are dropped so that closed windows leave the state."""
    win = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    out = metrics.withWatermark("created_at", late).groupBy("metric_name", win.alias("w")).agg(
        n_rows().alias("events"), F.avg("value").alias("value")
    )
    return out.select(
        "metric_name", F.col("w.start").alias("start"), "events", "value",
        st.metric_status(F.col("metric_name"), F.col("value")).alias("grade"),
    )


# --- progress and memory as keyed state --------------------------------------
PROGRESS = "batch_id long, processed long, failed long, total long, elapsed double, eta_seconds long, percent long, stalled boolean"
TURN = "conv_id long, turn long, role string, text string"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of keyed processors lives in RocksDB, not in the heap of an executor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BatchProgress(StatefulProcessor):
    """Totals of a batch from the steps of its files.

    State: the latest step of each file (a map), and the totals (one value), so
    an event costs one look-up however many files a batch has.  Steps told
    again, or after a later one, change nothing.  A batch that is silent for
    ``idle_ms`` is told once more as stalled if files are open, and forgotten.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "at double, further int")
        self.totals = handle.getValueState("totals", "processed long, failed long, total long, elapsed double")

    def _row(self, batch_id, stalled: bool):
        import pandas as pd

        processed, failed, total, elapsed = self.totals.get()
        left = max((total or 0) - processed, 0)
        eta = int(elapsed / processed * left) if processed else 0
        percent = int(processed / total * 100 + 0.5) if total else None
        return pd.DataFrame([(batch_id, processed, failed, total, elapsed, eta, percent, stalled)], columns=[f.split()[0] for f in PROGRESS.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        processed, failed, total, elapsed = self.totals.get() if self.totals.exists() else (0, 0, None, None)
        latest: dict[str, tuple[float, int]] = {}
        for pdf in rows:
            for file, step, of, at in zip(pdf["file"], pdf["step"], pdf["total"], pdf["at_seconds"]):
                known = (at, STEPS.index(step) + 1 if step in STEPS else 0)
                latest[file] = max(known, latest.get(file, known))
                total = of if total is None else max(total, of)
                elapsed = at if elapsed is None else max(elapsed, at)
        for file, step in latest.items():
            before = self.files.getValue((file,)) if self.files.containsKey((file,)) else None
            if before is not None and tuple(before) >= step:
                continue
            self.files.updateValue((file,), step)
            was, now = (STEPS[x - 1] if x else "" for x in (before[1] if before else 0, step[1]))
            processed += (now in CLOSED) - (was in CLOSED)
            failed += (now == "failed") - (was == "failed")
        self.totals.update((int(processed), int(failed), None if total is None else int(total), elapsed))
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        processed, _, total, _ = self.totals.get()
        row = self._row(key[0], True)
        self.files.clear()
        self.totals.clear()
        if total is None or processed < total:
            yield row

    def close(self) -> None:
        pass


def batch_progress(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``PROGRESS`` of every batch that an update touches, out of one keyed state; ``events`` as for ``latest_steps``.

    Without ``idle_ms`` no batch stalls; a run over what is available must be
    started that way, since a pending timer keeps a query alive.
    """
    keep_state_on_disk(events.sparkSession)
    return events.groupBy("batch_id").transformWithStateInPandas(BatchProgress(idle_ms), PROGRESS, "Update", "ProcessingTime" if idle_ms else "None")


class SessionMemory(StatefulProcessor):
    """The last turns of a session, as list state; turns told again are one, late ones find their place.

    With ``idle_ms`` every turn leaves the state so long after the session was
    last touched, which takes the place of evicting the oldest of a fixed number
    of sessions.
    """

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        kept = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        for pdf in rows:
            kept += list(zip(pdf["turn"].tolist(), pdf["role"].tolist(), pdf["text"].tolist()))
            kept = sorted(dict.fromkeys(kept), key=lambda t: t[0])[-self.keep:]
        self.turns.put(kept)
        yield pd.DataFrame({"conv_id": key[0], "turn": [t for t, _, _ in kept], "role": [r for _, r, _ in kept], "text": [x for _, _, x in kept]})

    def close(self) -> None:
        pass


def session_memory(turns: DataFrame, keep: int = 8, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Last ``keep`` turns of every session that an update touches."""
    keep_state_on_disk(turns.sparkSession)
    return turns.groupBy("conv_id").transformWithStateInPandas(SessionMemory(keep, idle_ms), TURN, "Update", "ProcessingTime" if idle_ms else "None")


# --- incremental normalization ----------------------------------------------
def normalize_arrivals(rows: DataFrame, path: str, checkpoint: str, scope: list[str], version: int = 1) -> StreamingQuery:
    """Resolve arriving reports and append them; rows that carry the current
    ``normalization_version`` were resolved when they were saved and stay as
    they are.  A batch that is replayed after a failure overwrites its own
    folder, so nothing is written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        current = F.coalesce(F.col("normalization_version") == version, F.lit(False))
        fresh = resolve_records(batch.where(~current).drop("normalization_version"), scope)
        kept = batch.where(current).drop("normalization_version")
        fresh.unionByName(kept, allowMissingColumns=True).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- exactly-once intake ----------------------------------------------------
def take_in(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store each text the first time its content arrives, however long ago
    that was: a batch leaves out what is stored already.  Stored keys have an
    index beside the texts (:class:`KeyStore`), of which a batch reads what it
    may hit.  A batch that is replayed after a failure looks at the other
    batches only and overwrites its own folder."""
    spark = texts.sparkSession
    keyed = texts.withColumn("content_key", content_key(F.col("text")))
    spark.createDataFrame([], keyed.schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    store = KeyStore(spark, f"{path.rstrip('/')}-index")

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch={batch_id}"
        store.unseen(batch, batch_id).write.mode("overwrite").parquet(folder)
        store.add(spark.read.schema(keyed.schema).parquet(folder), batch_id)

    return keyed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Update-mode run: every micro-batch is written with its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b{batch_id}")

    q = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    schema = T.StructType(stream.schema.fields + [T.StructField("_batch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
