"""The metrics dashboard over events, with metadata as the log's writers fill it."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.catalog.metrics_view import METRIC_OF, grade_sql, metric_name
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, table
from labtrail.operators import dashboard as da

AS_OF, DAYS = "2024-01-30", 14

# metadata as text, the same expression in both engines but for the way to join strings; some is no JSON, some numbers are text
_PARTS = [
    '{"filename": "f', "id", '.pdf", "fileSize": ', "size", ', "findingsCount": ', "found", ', "processingTimeMs": ', "ms", ', "failureReason": ', "why", ', "input_tokens": ', "tin", ', "output_tokens": ', "tout",
    ', "latency_ms": ', "ms", ', "precision": 0.', "pre", ', "recall": 0.', "rec", "}",
]


def telemetry(s, f):
    e = table(s, f, "events")
    i = F.col("event_id")
    text = {
        "id": i.cast("string"), "size": (i * 37).cast("string"), "found": F.when(i % 4 == 0, F.concat(F.lit('"'), (i % 20).cast("string"), F.lit('"'))).otherwise((i % 20).cast("string")), "ms": (i % 977).cast("string"),
        "why": F.when(i % 3 == 0, '"quota"').otherwise("null"), "tin": F.when(i % 5 > 0, (i % 1000).cast("string")).otherwise('"many"'), "tout": (i % 77).cast("string"), "pre": (10 + i % 90).cast("string"), "rec": (10 + i % 80).cast("string"),
    }
    doc = F.concat(*[text.get(p, F.lit(p)) for p in _PARTS])
    return e.select(
        i.alias("id"), F.when(i % 6 == 5, "extraction_f1").otherwise(metric_name(F.col("event_type"))).alias("metric_name"), F.when(i % 8 > 0, F.col("value")).otherwise(0.0).alias("value"),
        F.when(i % 9 == 0, '{"broken').when(i % 9 > 1, doc).alias("metadata"), F.col("ts").alias("created_at"),
    )


_text = {
    "id": "event_id", "size": "event_id * 37", "found": "CASE WHEN event_id % 4 = 0 THEN '\"' || (event_id % 20) || '\"' ELSE CAST(event_id % 20 AS VARCHAR) END", "ms": "event_id % 977",
    "why": "CASE WHEN event_id % 3 = 0 THEN '\"quota\"' ELSE 'null' END", "tin": "CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 1000 AS VARCHAR) ELSE '\"many\"' END", "tout": "event_id % 77", "pre": "10 + event_id % 90", "rec": "10 + event_id % 80",
}
_doc = " || ".join(f"CAST({_text[p]} AS VARCHAR)" if p in _text else f"'{p}'" for p in _PARTS)
_kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_OF.items())
SQL.add("telemetry", f"""SELECT event_id AS id, CASE WHEN event_id % 6 = 5 THEN 'extraction_f1' ELSE CASE event_type {_kinds} END END AS metric_name, CASE WHEN event_id % 8 > 0 THEN value ELSE 0.0 END AS value,
  CASE WHEN event_id % 9 > 1 THEN {_doc} END AS metadata, ts AS created_at FROM events""")
_types = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE"}
_read = ", ".join(f"TRY_CAST(json_extract_string(metadata, '$.{name}') AS {_types[kind]}) AS {c}" for c, (name, kind) in da.FIELDS.items())
SQL.add("telemetry_typed", f"SELECT id, metric_name, value, created_at, {_read} FROM telemetry WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND created_at < TIMESTAMP '{AS_OF}'", "telemetry")


def register() -> None:
    as_of = lambda: F.lit(AS_OF).cast("timestamp_ntz")
    r6 = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    targets = " ".join(f"WHEN '{n}' THEN '{'>=' if kind == 'min' else '<='} {ok:g}'" for n, (ok, _, kind) in fv.METRIC_THRESHOLDS.items())
    only = lambda kind, c, name, places="": f"CASE WHEN metric_name = '{kind}' THEN {f'round({c}, 6)' if places else c} END AS {name}"
    query("e35_dashboard_cards", f"""SELECT metric_name, events, round(current_value, 6) AS current_value, CASE metric_name {targets} END AS target_value, {grade_sql('metric_name', 'current_value')} AS grade,
      {only('json_validity', 'ok', 'valid_calls')}, {only('pdf_processing_success', 'ok', 'success_count')}, {only('pdf_processing_success', 'events - ok', 'failed_count')}, {only('pdf_processing_success', 'f', 'mean_findings', 'r')},
      {only('hallucination_detection', 'last_n', 'last_extractions')}, {only('hallucination_detection', 'last_sum', 'unsupported_in_last', 'r')}, {only('api_reliability', 'p95', 'p95_latency_ms', 'r')}, {only('api_reliability', 'l', 'mean_latency_ms', 'r')},
      {only('context_retention', 'events', 'runs')}, {only('context_retention', 'm', 'seven_day_mean', 'r')}, {only('extraction_f1', 'p', 'precision', 'r')}, {only('extraction_f1', 'r', 'recall', 'r')}
      FROM (SELECT metric_name, count(*) AS events, arg_max(value, ROW(created_at, id)) AS current_value, count(*) FILTER (WHERE value > 0) AS ok, avg(findings) AS f, avg(latency_ms) AS l, quantile_cont(latency_ms, 0.95) AS p95,
        avg(value) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {da.MEAN_DAYS} DAY) AS m, avg(precision) AS p, avg(recall) AS r FROM telemetry_typed GROUP BY 1)
      JOIN (SELECT metric_name, count(*) AS last_n, sum(value) AS last_sum FROM (SELECT * FROM telemetry_typed QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY created_at DESC, id DESC) <= {da.LAST}) GROUP BY 1) USING (metric_name)""", "telemetry_typed")(
        lambda s, f: r6(da.cards(telemetry(s, f), as_of(), DAYS)))
    query("e35_dashboard_series", "SELECT metric_name, CAST(created_at AS DATE) AS day, round(avg(value), 6) AS value FROM telemetry_typed GROUP BY 1, 2", "telemetry_typed")(lambda s, f: r6(da.card_series(telemetry(s, f), as_of(), DAYS)))
    query("e36_failed_uploads", """SELECT id, coalesce(filename, 'unknown') AS filename, round(coalesce(file_size, 0) / 1024, 1) AS size_kb, greatest(coalesce(findings, 0), 0) AS findings, coalesce(reason, 'unknown') AS reason,
      coalesce(processing_ms, 0) AS processing_ms, CAST(created_at AS DATE) AS day, CAST(row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC, id DESC) AS INTEGER) AS place
      FROM telemetry_typed WHERE metric_name = 'pdf_processing_success' AND (reason IS NOT NULL OR NOT value > 0)""", "telemetry_typed")(lambda s, f: da.failed_files(telemetry(s, f), as_of(), DAYS))
    query("e36_token_use", """SELECT CAST(created_at AS DATE) AS day, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, count(*) AS calls
      FROM telemetry_typed WHERE input_tokens IS NOT NULL OR output_tokens IS NOT NULL GROUP BY 1""", "telemetry_typed")(lambda s, f: da.token_use(telemetry(s, f), as_of(), DAYS))
