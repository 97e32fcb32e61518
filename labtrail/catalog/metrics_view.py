"""Telemetry view over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.catalog.views import SQL, table

METRIC_OF = {
    "click": "json_validity", "view": "pdf_processing_success", "purchase": "hallucination_detection",
    "signup": "api_reliability", "error": "context_retention",
}


def metric_name(c):
    out = None
    for k, v in METRIC_OF.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def from_events(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("id"), metric_name(F.col("event_type")).alias("metric_name"),
        F.col("value"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"),
        F.col("user_id"),
    )


def metrics(spark, sf) -> DataFrame:
    return from_events(table(spark, sf, "events"))


_cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_OF.items())
SQL.add("metrics", f"SELECT event_id AS id, CASE event_type {_cases} END AS metric_name, value, props AS metadata, ts AS created_at, user_id FROM events")


def grade_sql(m: str, v: str) -> str:
    out = []
    for name, (ok, warn, kind) in fv.METRIC_THRESHOLDS.items():
        op = ">=" if kind == "min" else "<="
        out.append(f"WHEN '{name}' THEN CASE WHEN {v} {op} {ok} THEN 'ok' WHEN {v} {op} {warn} THEN 'warn' ELSE 'fail' END")
    return f"CASE {m} {' '.join(out)} ELSE 'warn' END"
