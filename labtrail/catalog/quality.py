"""Extraction quality, telemetry, guideline retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.catalog import duck as d
from labtrail.catalog.metrics_view import grade_sql, metrics
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, sql_list, sql_text, table
from labtrail.functions import values as va
from labtrail.operators import chat as ch
from labtrail.operators import guidelines as gl
from labtrail.operators import quality as qu
from labtrail.operators import timelines as tl

AS_OF = "2024-06-01"


def truth(s, f):
    """Ground truth: numeric findings of every report with their position."""
    r = lab_records(s, f)
    return r.select("report_id", F.lower(F.trim("Test_Name")).alias("name"), va.leading_numeric(F.col("Result")).alias("value"), F.col("row_ord").alias("pos"), F.length("Result").alias("len")).where("value IS NOT NULL")


def extracted(s, f):
    """What was read: some findings missing, doubled or slightly off."""
    t = truth(s, f)
    k = F.col("report_id") % 5
    off = F.when(k == 1, F.col("value") + 0.005).when(k == 2, F.col("value") + 1).otherwise(F.col("value"))
    kept = t.where((k != 3) | (F.col("len") % 2 == 0)).withColumn("value", off).drop("len")
    twice = t.where(k == 4).drop("len").withColumn("pos", F.concat("pos", F.lit("x")))
    return kept.unionByName(twice)


SQL.add("truth", f"""SELECT * FROM (SELECT report_id, lower(trim("Test_Name")) AS name, {d.leading_numeric('"Result"')} AS value, row_ord AS pos, length("Result") AS len FROM lab_records) WHERE value IS NOT NULL""", "lab_records")
SQL.add("extracted", """SELECT report_id, name, CASE report_id % 5 WHEN 1 THEN value + 0.005 WHEN 2 THEN value + 1 ELSE value END AS value, pos FROM truth WHERE report_id % 5 <> 3 OR len % 2 = 0
  UNION ALL SELECT report_id, name, value, pos || 'x' FROM truth WHERE report_id % 5 = 4""", "truth")
# distinct truth values are at least 0.1 apart, so matching is a count per value
SQL.add("f1", """SELECT report_id, true_positives, e - true_positives AS false_positives, t - true_positives AS false_negatives, CASE WHEN e > 0 THEN true_positives / e ELSE 0.0 END AS precision, CASE WHEN t > 0 THEN true_positives / t ELSE 0.0 END AS recall FROM (
  SELECT report_id, CAST(sum(least(e, t)) AS BIGINT) AS true_positives, CAST(sum(e) AS BIGINT) AS e, CAST(sum(t) AS BIGINT) AS t FROM (SELECT report_id, name, v, count(*) FILTER (WHERE s = 0) AS e, count(*) FILTER (WHERE s = 1) AS t FROM
  (SELECT report_id, name, round(value, 1) AS v, 1 AS s FROM truth UNION ALL SELECT report_id, name, round(value, 1), 0 FROM extracted) GROUP BY ALL) GROUP BY 1)""", "truth", "extracted")


def findings(s, f):
    r = lab_records(s, f)
    v = va.leading_numeric(F.col("Result"))
    return r.select("report_id", "row_ord", F.col("Test_Name").alias("test_name"), v.alias("value"), F.regexp_replace(v.cast("string"), r"\.0$", "").alias("shown"))


def texts(s, f):
    """Source texts; the number of the document is printed at its end."""
    t = table(s, f, "documents")
    tail = F.concat(F.lit(" value "), (F.col("doc_id") % 50).cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"), F.lit(" end"))
    return t.select(F.col("doc_id").alias("report_id"), F.concat("text", tail).alias("text"))


SQL.add("unsupported", f"""SELECT f.report_id, f.row_ord, f.value, CASE WHEN t IS NULL THEN 'no text' ELSE 'not in text' END AS reason FROM (SELECT report_id, row_ord, {d.leading_numeric('"Result"')} AS value FROM lab_records) f
  LEFT JOIN (SELECT doc_id, text || ' value ' || (doc_id % 50) || '.' || (doc_id % 10) || ' end' AS t FROM documents) d ON d.doc_id = f.report_id WHERE value IS NOT NULL
  AND (t IS NULL OR NOT contains(t, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')) AND NOT contains(t, printf('%.1f', value)) AND NOT contains(t, printf('%.2f', value)))""", "lab_records")


def questions(s, f):
    e = table(s, f, "events")
    base = e.select("event_id", "user_id", "event_type")
    text = F.concat(F.element_at(F.array(*[F.lit(w) for w in QUESTIONS]), (F.col("event_id") % 5 + 1).cast("int")), F.lit(" "), F.col("event_type"))
    found = F.element_at(F.array(*[F.array(*[F.lit(x) for x in fs]) for fs in FINDINGS]), (F.col("user_id") % 4 + 1).cast("int"))
    return base.select(F.col("event_id").cast("string").alias("question_id"), text.alias("query"), found.alias("findings"))


QUESTIONS = ["my sugar is high", "is the cholesterol worse", "What should I do about the Thyroid?", "explain (CRP) + 5%", "kidney-risk history"]
FINDINGS = [["hba1c", "fasting blood glucose"], ["ldl cholesterol", "hdl", "triglycerides"], ["serum creatinine", "egfr (estimated)", "urea"], ["", "vitamin b12 cobalamin", "haemoglobin hb"]]

SQL.add("kb", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {', '.join(sql_text(e[c]) for c in ('id', 'category', 'title', 'source', 'url', 'level'))}, {sql_list(e['names'] + e['aliases'])}, {sql_list(e['keywords'])}, {sql_list(e['related'])}, DATE '{e['updated']}-01')"
    for i, e in enumerate(fv.GUIDELINES)) + ") AS t(ord, id, category, title, source, url, level, names_, keywords_, related_, updated)")
_normed = lambda c: f"list_transform({c}, lambda k_: {d.query_text('k_')})"
SQL.add("kb_terms", f"SELECT *, {_normed('names_')} AS names, {_normed('keywords_')} AS keywords, {_normed('related_')} AS related FROM kb", "kb")
_tok = d.query_tokens("q")
_cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_list(v)}" for k, v in fv.CONCEPT_EXPANSIONS.items())
SQL.add("asked", f"""SELECT CAST(event_id AS VARCHAR) AS question_id, ({sql_list(QUESTIONS)})[event_id % 5 + 1] || ' ' || event_type AS text, [{', '.join(sql_list(x) for x in FINDINGS)}][user_id % 4 + 1] AS f FROM events""")
_any = lambda terms: "(" + " OR ".join(f"contains(q, {sql_text(t)})" for t in terms) + ")"
_age = f"date_diff('day', updated, DATE '{AS_OF}') / 30.0"
_why = gl.REASONS
_told = f"""list_concat(flatten(list_transform(list_filter(f, lambda x_: x_ <> ''), lambda x_: list_concat(
    list_transform(list_filter(names, lambda n1_: contains(x_, n1_) OR contains(n1_, x_)), lambda n2_: {{'term': n2_, 'why': CASE WHEN n2_ = x_ THEN '{_why["exact"]}' ELSE '{_why["partial"]}' END, 'p': CASE WHEN n2_ = x_ THEN 28 ELSE 18 END}}),
    list_transform(list_filter(related, lambda n3_: contains(x_, n3_) OR contains(n3_, x_)), lambda n4_: {{'term': n4_, 'why': '{_why["related"]}', 'p': 9}})))),
  list_transform(list_filter(names, lambda n5_: contains(q, n5_)), lambda n6_: {{'term': n6_, 'why': '{_why["alias"]}', 'p': 20}}),
  list_transform(list_filter(keywords, lambda n7_: contains(q, n7_)), lambda n8_: {{'term': n8_, 'why': '{_why["keyword"]}', 'p': 8}}),
  list_transform(list_filter(toks, lambda t_: length(t_) >= 2 AND (len(list_filter(names, lambda n9_: contains(n9_, t_))) > 0 OR len(list_filter(keywords, lambda m1_: contains(m1_, t_))) > 0)), lambda m2_: {{'term': m2_, 'why': NULL, 'p': 3}}))"""
_aligned = "list_filter([" + ", ".join(f"CASE WHEN {_any(fv.INTENT_TERMS[i])} THEN '{why}' END" for i, (_, _, why) in gl.INTENTS.items()) + "], lambda z_: z_ IS NOT NULL)"
_first = lambda c: f"list_filter({c}, lambda y_, i_: list_position({c}, y_) = i_)"


def score_views(name: str, asked: str) -> None:
    """Views of the scores of every guideline for the questions of view ``asked`` (question_id, text, f)."""
    SQL.add(f"{name}_kinds", f"SELECT text, f AS f0, {d.query_text('text')} AS q, list_transform(f, lambda y_: {d.query_text('y_')}) AS f FROM (SELECT DISTINCT text, f FROM {asked})", asked)
    SQL.add(f"{name}_tok", f"SELECT *, {_first(f'list_transform(list_concat({_tok}, flatten(list_transform({_tok}, lambda c_: CASE c_ {_cases} ELSE [] END))), lambda w_: ' + d.query_text('w_') + ')')} AS toks FROM {name}_kinds", f"{name}_kinds")
    SQL.add(f"{name}_told", f"SELECT a.text, a.f0, a.q, k.*, {_told} AS told FROM {name}_tok a, kb_terms k", f"{name}_tok", "kb_terms")
    SQL.add(f"{name}_score", f"""SELECT text, f0, ord, id, category, title, source, url, level, {_first("list_transform(told, lambda t1_: t1_.term)")} AS terms,
      list_concat(list_filter(list_transform(told, lambda t2_: t2_.why), lambda t3_: t3_ IS NOT NULL), {_aligned}) AS why,
      CAST(coalesce(list_sum(list_transform(told, lambda t4_: t4_.p)), 0)
      + CASE WHEN {_any(fv.INTENT_TERMS['trend'])} THEN 5 ELSE 0 END + CASE WHEN {_any(fv.INTENT_TERMS['urgency'])} THEN 5 ELSE 0 END + CASE WHEN {_any(fv.INTENT_TERMS['action'])} THEN 4 ELSE 0 END
      + CASE level WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END + CASE WHEN {_age} <= 12 THEN 3 WHEN {_age} <= 24 THEN 2 WHEN {_age} <= 36 THEN 1 ELSE 0 END AS INTEGER) AS score FROM {name}_told""", f"{name}_told")
    SQL.add(f"{name}_hits", f"SELECT *, CAST(row_number() OVER (PARTITION BY text, f0 ORDER BY score DESC, ord) AS INTEGER) AS rank FROM (SELECT * FROM {name}_score WHERE score >= 15 QUALIFY row_number() OVER (PARTITION BY text, f0, category ORDER BY score DESC, ord) = 1 OR score >= 30) QUALIFY rank <= 3", f"{name}_score")


score_views("kb", "asked")
# what patients ask: each turn of a user, behind it the six turns before; patients by the number of the conversation
SQL.add("turns_asked", """SELECT conv_id || '-' || turn AS question_id, CAST(conv_id AS VARCHAR) AS scope_id, turn, text AS message, coalesce(history, []) AS history FROM
  (SELECT conv_id, turn, role, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM
    (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)) WHERE role = 'user'""")
SQL.add("top_names", "SELECT scope_id, list(canonical ORDER BY rk) AS f FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY day DESC, first_ord) AS rk FROM latestc) WHERE rk <= 10 GROUP BY 1", "latestc")
SQL.add("chat_asked", "SELECT q.*, q.message || ' ' || array_to_string(q.history, ' ') AS text, n.f FROM turns_asked q JOIN top_names n USING (scope_id)", "turns_asked", "top_names")
score_views("chat", "chat_asked")
SQL.add("chat_sections", """SELECT a.question_id, count(*) AS n_guidelines, string_agg('[' || h.source || ']  [retrieval score: ' || h.score || ']' || chr(10) || h.title || chr(10) || 'Category: ' || h.category || chr(10)
  || 'Matched retrieval terms: ' || CASE WHEN len(h.terms) > 0 THEN array_to_string(h.terms, ', ') ELSE 'none' END || chr(10) || 'Retrieval rationale: ' || CASE WHEN len(h.why) > 0 THEN array_to_string(h.why, ', ') ELSE 'semantic overlap' END
  || chr(10) || 'Evidence level: ' || h.level || chr(10) || 'Cite as: "' || h.source || '" - ' || h.url, chr(10) || chr(10) ORDER BY h.rank) AS guidelines
  FROM chat_asked a JOIN chat_hits h ON h.text = a.text AND h.f0 = a.f GROUP BY 1""", "chat_asked", "chat_hits")


def retained(s, f):
    c = table(s, f, "conversations").where("role = 'assistant'")
    return c.select("conv_id", F.array(F.lit("LA"), F.lit("zzz")).alias("keywords"), F.col("text").alias("reply"))


def register() -> None:
    m = lambda s, f: metrics(s, f)
    query("j12_extracted_truth_match", "SELECT report_id, true_positives FROM f1", "f1")(
        lambda s, f: qu.extraction_f1(extracted(s, f), truth(s, f)).select("report_id", "true_positives"))
    query("e32_extraction_f1", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM f1", "f1")(lambda s, f: qu.extraction_f1(extracted(s, f), truth(s, f)))
    query("j14_value_in_text", "SELECT report_id, row_ord, value, reason FROM unsupported", "unsupported")(lambda s, f: qu.unsupported_values(findings(s, f), texts(s, f)).select("report_id", "row_ord", "value", "reason"))
    query("e33_unsupported_values", "SELECT report_id, count(*) FILTER (WHERE reason = 'not in text') AS unsupported, count(*) FILTER (WHERE reason = 'no text') AS no_text FROM unsupported GROUP BY 1", "unsupported")(lambda s, f: qu.unsupported_counts(findings(s, f), texts(s, f)))
    query("e34_context_retention", "SELECT conv_id, count(*) FILTER (WHERE contains(lower(text), 'la') OR contains(lower(text), 'zzz')) AS retained, count(*) AS turns, count(*) FILTER (WHERE contains(lower(text), 'la') OR contains(lower(text), 'zzz')) / count(*) * 100 AS score FROM conversations WHERE role = 'assistant' GROUP BY 1")(
        lambda s, f: qu.context_retention(retained(s, f)))
    r6 = lambda df, *cs: df.select(*[F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns])
    SQL.add("daily", f"SELECT metric_name, day, events, value, {grade_sql('metric_name', 'value')} AS grade FROM (SELECT metric_name, CAST(created_at AS DATE) AS day, count(*) AS events, avg(value) AS value FROM metrics GROUP BY 1, 2)", "metrics")
    query("e35_metric_daily_series", "SELECT * REPLACE (round(value, 6) AS value) FROM daily", "daily")(lambda s, f: r6(qu.daily_metrics(m(s, f)), "value"))
    query("e35_metric_cards", """SELECT metric_name, count(*) AS events, round(avg(value), 6) AS mean_value, arg_max(value, ROW(created_at, id)) AS current_value, count(*) FILTER (WHERE value > 0) AS valid, round(quantile_cont(value, 0.95), 6) AS p95
      FROM metrics WHERE created_at >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY GROUP BY 1""", "metrics")(
        lambda s, f: r6(qu.metric_cards(m(s, f), F.lit("2024-01-30").cast("timestamp_ntz"), 14), "mean_value", "p95"))
    query("w11_seven_day_mean", "SELECT metric_name, day, round(avg(value) OVER (PARTITION BY metric_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) AS seven_day_mean FROM daily", "daily")(
        lambda s, f: r6(qu.seven_day_means(qu.daily_metrics(m(s, f))), "seven_day_mean").select("metric_name", "day", "seven_day_mean"))
    query("w11_last_hundred", "SELECT metric_name, count(*) AS last_events, round(sum(value), 4) AS last_sum FROM (SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY created_at DESC, id DESC) <= 100) GROUP BY 1", "metrics")(
        lambda s, f: qu.last_events(m(s, f)).withColumn("last_sum", F.round("last_sum", 4)))
    query("e36_token_usage", "SELECT CAST(created_at AS DATE) AS day, CAST(sum(CAST(json_extract_string(metadata, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens, count(*) AS calls FROM metrics GROUP BY 1", "metrics")(lambda s, f: qu.token_usage(m(s, f)))
    query("e36_failed_files", "SELECT id, json_extract_string(metadata, '$.k') AS findings, value FROM metrics WHERE metric_name = 'pdf_processing_success' AND value < 90", "metrics")(lambda s, f: qu.failed_files(m(s, f)).drop("created_at"))

    def outcomes(s, f):
        o = table(s, f, "orders")
        k = F.col("o_orderkey")
        files = o.select(F.col("o_custkey").alias("batch_id"), k.alias("pos"), F.concat(F.lit("f"), k.cast("string")).alias("file"), (k % 3 > 0).alias("ok"),
                         F.when(k % 2 == 0, "Rate limit hit").otherwise("quota").alias("reason"), (k % 10).cast("double").alias("seconds"), F.lit(20).alias("total"))
        return qu.ingest_outcome(files)

    query("e40_ingest_outcome", """SELECT batch_id, processed, failed, total, CAST(floor(elapsed / processed * greatest(total - processed, 0)) AS BIGINT) AS eta_seconds, coalesce(details, '') AS details, failed > 0 AS all_rate_limited FROM
      (SELECT o_custkey AS batch_id, count(*) AS processed, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS failed, 20 AS total, CAST(sum(o_orderkey % 10) AS DOUBLE) AS elapsed FROM orders GROUP BY 1)
      LEFT JOIN (SELECT o_custkey AS batch_id, string_agg('f' || o_orderkey || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Rate limit hit' ELSE 'quota' END, '; ' ORDER BY o_orderkey) AS details FROM
        (SELECT * FROM orders WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5) GROUP BY 1) USING (batch_id)""")(outcomes)
    asked_as_of = lambda: F.lit(AS_OF).cast("date")
    joined = lambda df: df.withColumn("matched_terms", F.array_join("matched_terms", "|")).withColumn("rationale", F.array_join("rationale", "|"))
    query("p13_guideline_retrieval", """SELECT a.question_id, h.id, h.category, h.title, h.source, h.url, h.level, h.score, h.rank, array_to_string(h.terms, '|') AS matched_terms, array_to_string(h.why, '|') AS rationale
      FROM asked a JOIN kb_hits h ON h.text = a.text AND h.f0 = a.f""", "asked", "kb_hits")(lambda s, f: joined(gl.retrieve(questions(s, f), gl.knowledge(s), asked_as_of())).drop("ord", "content"))
    counted = ", ".join(f"CAST(len(list_filter(h.why, lambda v_: v_ = '{why}')) AS INTEGER) AS n_{key}" for key, why in gl.REASONS.items())
    query("j13_question_guideline_scores", f"""SELECT a.question_id, h.id, h.category, h.source, h.url, h.score, h.ord, {counted}, CAST(len(h.terms) AS INTEGER) AS n_terms FROM asked a JOIN kb_score h ON h.text = a.text AND h.f0 = a.f WHERE h.score >= 15""", "asked", "kb_score")(
        lambda s, f: gl.all_scores(questions(s, f), gl.knowledge(s), asked_as_of()))
    query("w07_category_diverse_top", """SELECT a.question_id, h.category, h.id, h.score, h.rank FROM asked a JOIN
      (SELECT *, CAST(row_number() OVER (PARTITION BY text, f0 ORDER BY score DESC, ord) AS INTEGER) AS rank FROM (SELECT * FROM kb_score WHERE score >= 8 QUALIFY row_number() OVER (PARTITION BY text, f0, category ORDER BY score DESC, ord) = 1 OR score >= 40) QUALIFY rank <= 5) h
      ON h.text = a.text AND h.f0 = a.f""", "asked", "kb_score")(
        lambda s, f: gl.diverse_top(gl.all_scores(questions(s, f), gl.knowledge(s), asked_as_of(), 8), ["question_id"], 5, 40).select("question_id", "category", "id", "score", "rank"))

    def context(s, f):
        turns = table(s, f, "conversations").withColumn("scope_id", F.col("conv_id").cast("string"))
        return ch.chat_context(tl.chat_findings(lab_records(s, f)), turns, gl.knowledge(s), asked_as_of()).withColumn("history", F.size("history").cast("long"))

    query("p12_chat_context", """SELECT q.question_id, q.scope_id, q.turn, q.message, len(q.history) AS history, p.* EXCLUDE (scope_id), coalesce(g.n_guidelines, 0) AS n_guidelines, coalesce(g.guidelines, '') AS guidelines
      FROM chat_asked q JOIN parts p ON p.scope_id = q.scope_id LEFT JOIN chat_sections g ON g.question_id = q.question_id""", "chat_asked", "parts", "chat_sections")(context)
