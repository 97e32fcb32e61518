"""The metrics dashboard: cards, daily series, failed files and token use of a telemetry log.

Metadata is JSON text that every kind of event fills differently.  It is parsed
once, to VARIANT, and the fields that the dashboard shows are read from it with
their types (``FIELDS``): a number written as text counts, anything else that
doesn't fit is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions import status as st
from labtrail.functions.basic import n_rows
from labtrail.operators.quality import exact_percentile, last_events

# fixed values: fields of the metadata, by their names there
FIELDS = {
    "filename": ("filename", "string"), "file_size": ("fileSize", "long"), "findings": ("findingsCount", "long"), "processing_ms": ("processingTimeMs", "long"), "reason": ("failureReason", "string"),
    "input_tokens": ("input_tokens", "long"), "output_tokens": ("output_tokens", "long"), "latency_ms": ("latency_ms", "double"), "precision": ("precision", "double"), "recall": ("recall", "double"),
}
LAST = 100
#: Values of this many days make the mean of a card.
MEAN_DAYS = 7


def with_fields(metrics: DataFrame) -> DataFrame:
    """Telemetry rows (id, metric_name, value, metadata, created_at) with ``FIELDS`` as typed columns."""
    tree = F.col("_tree")
    parsed = metrics.withColumn("_tree", F.try_parse_json("metadata"))
    return parsed.select(*metrics.columns, *[F.try_variant_get(tree, f"$.{name}", kind).alias(c) for c, (name, kind) in FIELDS.items()]).drop("metadata")


def within(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    return metrics.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("created_at") < as_of))


def target(metric: Column) -> Column:
    """What a metric should reach, as it is shown."""
    out = F.lit(None).cast("string")
    for name, (ok, _, kind) in fv.METRIC_THRESHOLDS.items():
        out = F.when(metric == name, f"{'>=' if kind == 'min' else '<='} {ok:g}").otherwise(out)
    return out


def cards(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One card per metric over the last ``days`` before ``as_of``: its value, target and grade, and the figures under it.

    A card has the figures of its kind, the others are null: valid calls; files
    that succeeded and failed and their findings; unsupported values in the last
    hundred extractions; latency; runs and their seven-day mean; precision and
    recall.
    """
    rows = with_fields(within(metrics, as_of, days))
    name = F.col("metric_name")
    only = lambda kind, c: F.when(name == kind, c)
    ok = F.col("value") > 0
    recent = F.col("created_at") >= as_of - F.make_dt_interval(F.lit(MEAN_DAYS))
    sums = rows.groupBy("metric_name").agg(
        n_rows().alias("events"), F.max_by("value", F.struct("created_at", "id")).alias("current_value"), F.count_if(ok).alias("_ok"),
        F.avg("findings").alias("_findings"), F.avg("latency_ms").alias("_latency"), F.avg(F.when(recent, F.col("value"))).alias("_mean"), F.avg("precision").alias("_precision"), F.avg("recall").alias("_recall"),
    )
    tail = exact_percentile(rows, "metric_name", "latency_ms", 0.95).withColumnRenamed("p", "_p95")
    out = sums.join(tail, "metric_name", "left").join(last_events(rows, LAST), "metric_name")
    failed = F.col("events") - F.col("_ok")
    return out.select(
        "metric_name", "events", "current_value", target(name).alias("target_value"), st.metric_status(name, F.col("current_value")).alias("grade"),
        only("json_validity", F.col("_ok")).alias("valid_calls"), only("pdf_processing_success", F.col("_ok")).alias("success_count"), only("pdf_processing_success", failed).alias("failed_count"),
        only("pdf_processing_success", F.col("_findings")).alias("mean_findings"), only("hallucination_detection", F.col("last_events")).alias("last_extractions"), only("hallucination_detection", F.col("last_sum")).alias("unsupported_in_last"),
        only("api_reliability", F.col("_p95")).alias("p95_latency_ms"), only("api_reliability", F.col("_latency")).alias("mean_latency_ms"), only("context_retention", F.col("events")).alias("runs"),
        only("context_retention", F.col("_mean")).alias("seven_day_mean"), only("extraction_f1", F.col("_precision")).alias("precision"), only("extraction_f1", F.col("_recall")).alias("recall"),
    )


def card_series(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(metric_name, day, value): the mean of each day of the window."""
    return within(metrics, as_of, days).groupBy("metric_name", F.to_date("created_at").alias("day")).agg(F.avg("value").alias("value"))


def failed_files(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Files that were not processed, newest first (``place``): size, findings, time and reason."""
    rows = with_fields(within(metrics.where("metric_name = 'pdf_processing_success'"), as_of, days)).where(F.col("reason").isNotNull() | ~(F.col("value") > 0))
    day = F.to_date("created_at")
    # places within a day, so that no task holds all of them
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.desc("created_at"), F.desc("id")))
    return rows.select(
        "id", F.coalesce("filename", F.lit("unknown")).alias("filename"), F.round(F.coalesce("file_size", F.lit(0)) / 1024, 1).alias("size_kb"), F.greatest(F.coalesce("findings", F.lit(0)), F.lit(0)).alias("findings"),
        F.coalesce("reason", F.lit("unknown")).alias("reason"), F.coalesce("processing_ms", F.lit(0)).alias("processing_ms"), day.alias("day"), place.alias("place"),
    )


def token_use(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(day, input_tokens, output_tokens, calls) of the days on which tokens were counted."""
    rows = with_fields(within(metrics, as_of, days)).where(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull())
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(total("input_tokens"), total("output_tokens"), n_rows().alias("calls"))
