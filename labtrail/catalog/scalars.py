"""Scalar functions (section C and M), each over a whole text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.catalog import duck as d
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, sql_list, sql_text, table
from labtrail.functions import names as nm
from labtrail.functions import status as st
from labtrail.functions import text as tx
from labtrail.functions import values as va


# --- input columns: one text column named x ---------------------------------
def name_texts(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    made = (
        F.when(k == 0, F.concat(n, F.lit(" (sr)")))
        .when(k == 1, F.concat(n, F.lit(" (rg) - "), F.col("p_type"), F.lit(" (total)")))
        .otherwise(F.concat(F.upper(n), F.lit(" / ["), F.col("p_brand"), F.lit("]_levels")))
    )
    return lab_records(spark, sf).select(F.col("Test_Name").alias("x")).unionByName(
        part.select(made.alias("x"))
    )


SQL.add("name_texts", """SELECT "Test_Name" AS x FROM lab_records UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN p_name || ' (sr)'
  WHEN 1 THEN p_name || ' (rg) - ' || p_type || ' (total)' ELSE upper(p_name) || ' / [' || p_brand || ']_levels' END FROM part""", "lab_records")


def column_of(column: str):
    return lambda spark, sf: lab_records(spark, sf).select(F.col(column).alias("x"))


for _c in ("Test_Category", "Status", "Result", "Test_Date", "Reference_Range", "Unit", "Lab_Name",
           "Patient_Name", "Source_Filename", "Test_Name"):
    SQL.add(f"x_{_c.lower()}", f'SELECT "{_c}" AS x FROM lab_records', "lab_records")


# dates in the shapes that reports print them, by Spark's and by DuckDB's pattern
DATE_SHAPES = [
    ("yyyy-MM-dd'T'10:00:00", "%Y-%m-%dT10:00:00"), ("yyyy-MM-dd 00:00:00", "%Y-%m-%d 00:00:00"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMMM yyyy", "%-d %B %Y"),
    ("d MMM yyyy", "%-d %b %Y"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("yyyyMMdd", "%Y%m%d"), ("dd.MM.yyyy", "%d.%m.%Y"), ("dd/MM/yyyy HH:mm", "%d/%m/%Y 00:00"), ("'soon'", "soon"),
]


# shapes that only the day-first reader knows
LOOSE_SHAPES = [
    ("dd-MMM-yy", "%d-%b-%y"), ("dd/MMM/yyyy", "%d/%b/%Y"), ("d MMM yy", "%-d %b %y"), ("MMM yyyy", "%b %Y"), ("yyyy-MM", "%Y-%m"), ("M/d/yyyy", "%-m/%-d/%Y"), ("EEEE, d MMM yyyy", "%A, %-d %b %Y"),
    ("d.M.yy", "%-d.%-m.%y"), ("MM-dd-yy", "%m-%d-%y"), ("MMMM d, yy", "%B %-d, %y"), ("yyyy MMM d", "%Y %b %-d"), ("MM/yyyy", "%m/%Y"), ("EEE dd/MM/yyyy", "%a %d/%m/%Y"), ("M.d.yyyy", "%-m.%-d.%Y"),
]


def loose_texts(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    n = len(LOOSE_SHAPES)
    shape = F.coalesce(*[F.when(F.col("o_orderkey") % n == i, F.date_format("o_orderdate", pattern)) for i, (pattern, _) in enumerate(LOOSE_SHAPES)])
    return date_texts(spark, sf).unionByName(o.select(shape.alias("x")))


def date_texts(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate")
    shape = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(DATE_SHAPES):
        # a time of day that isn't the date's own is put behind it as text
        if ":" in pattern and "HH" not in pattern:
            head, tail = pattern[:10], pattern[10:].replace("'", "")
            value = F.concat(F.date_format(day, head), F.lit(tail))
        else:
            value = F.date_format(day.cast("timestamp"), pattern)
        shape = F.when(F.col("o_orderkey") % len(DATE_SHAPES) == i, value).otherwise(shape)
    return column_of("Test_Date")(spark, sf).unionByName(o.select(shape.alias("x")))


_shapes = " ".join(f"WHEN {i} THEN strftime(o_orderdate, {sql_text(p)})" for i, (_, p) in enumerate(DATE_SHAPES))
SQL.add("date_texts", f"SELECT x FROM x_test_date UNION ALL SELECT CASE o_orderkey % {len(DATE_SHAPES)} {_shapes} END FROM orders", "x_test_date")
_loose = " ".join(f"WHEN {i} THEN strftime(o_orderdate, {sql_text(p)})" for i, (_, p) in enumerate(LOOSE_SHAPES))
SQL.add("loose_texts", f"SELECT x FROM date_texts UNION ALL SELECT CASE o_orderkey % {len(LOOSE_SHAPES)} {_loose} END FROM orders", "date_texts")


def status_texts(spark, sf) -> DataFrame:
    return column_of("Status")(spark, sf).unionByName(
        table(spark, sf, "orders").select(F.col("o_orderpriority").alias("x"))
    )


SQL.add("status_texts", "SELECT x FROM x_status UNION ALL SELECT o_orderpriority FROM orders", "x_status")


def chat_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("text").alias("x"))


SQL.add("chat_texts", "SELECT text AS x FROM conversations")


def document_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("text").alias("x"))


def url_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("url").alias("x")).unionByName(
        column_of("Source_Filename")(spark, sf)
    )


SQL.add("url_texts", "SELECT url AS x FROM pages UNION ALL SELECT x FROM x_source_filename", "x_source_filename")


def question_texts(spark, sf) -> DataFrame:
    words = ["my sugar is high", "is the cholesterol worse", "What should I do about the Thyroid?",
             "explain (CRP) + 5%", "kidney-risk history"]
    arr = F.array(*[F.lit(w) for w in words])
    return table(spark, sf, "events").select(
        F.concat(F.element_at(arr, (F.col("event_id") % 5 + 1).cast("int")), F.lit(" "), F.col("event_type")).alias("x")
    )


SQL.add("question_texts", """SELECT (['my sugar is high', 'is the cholesterol worse', 'What should I do about the Thyroid?',
  'explain (CRP) + 5%', 'kidney-risk history'])[event_id % 5 + 1] || ' ' || event_type AS x FROM events""")


def failure_texts(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    v = F.round(F.col("value") * 100).cast("bigint").cast("string")
    k = F.col("event_id") % 5
    return e.select(
        F.when(k == 0, F.concat(F.lit("429 Quota exceeded, please retry in "), v, F.lit("s.")))
        .when(k == 1, F.concat(F.lit("Rate limit: Retry in "), v, F.lit("ms")))
        .when(k == 2, F.concat(F.lit("timeout after "), v))
        .when(k == 3, F.lit("error:429 retry in 1.2.3s"))
        .otherwise(None).alias("x")
    )


SQL.add("failure_texts", """SELECT CASE event_id % 5 WHEN 0 THEN '429 Quota exceeded, please retry in ' || v || 's.'
  WHEN 1 THEN 'Rate limit: Retry in ' || v || 'ms' WHEN 2 THEN 'timeout after ' || v WHEN 3 THEN 'error:429 retry in 1.2.3s' END AS x
  FROM (SELECT event_id, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v FROM events)""")


# --- registration -----------------------------------------------------------
def scalar(name, source, spark_cols, sql_view=None, sql_cols=None):
    """Distinct inputs, how often each occurs, and the function's answers."""

    def run(spark, sf) -> DataFrame:
        distinct = source(spark, sf).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        return distinct.select("x", "n", *[c.alias(k) for k, c in spark_cols().items()])

    sql = None
    if sql_cols:
        cols = ", ".join(f"{v} AS {k}" for k, v in sql_cols.items())
        sql = f"SELECT x, n, {cols} FROM (SELECT x, count(*) AS n FROM {sql_view} GROUP BY x)"
    query(name, sql, *([sql_view] if sql else []))(run)


EXPORTED = "replace(nullif(regexp_extract(lower(x), 'medical_reports?_.*?_([^_]+(?:_[^_]+)*)', 1), ''), '_', ' ')"
J = lambda c: F.array_join(c, "|")
DJ = lambda c: f"array_to_string({c}, '|')"



def register_names() -> None:
    scalar("c01_lookup_key", name_texts, lambda: {"y": nm.lookup_key(F.col("x"))}, "name_texts", {"y": d.lookup_key("x")})
    scalar("c02_compact", name_texts, lambda: {"y": nm.compact(F.col("x"))}, "name_texts", {"y": d.compact("x")})
    toks = "list_filter(regexp_split_to_array(lower(x), '[\\s\\-/,.]+'), lambda t0_: t0_ <> '')"
    scalar("c03_tokenize", name_texts, lambda: {"y": J(nm.tokens(F.col("x")))}, "name_texts", {"y": DJ(toks)})
    scalar("c04_initials", name_texts, lambda: {"y": nm.initials(F.col("x"))}, "name_texts",
           {"y": f"array_to_string(list_transform({toks}, lambda i0_: left(i0_, 1)), '')"})
    scalar("c05_structural_clean", name_texts, lambda: {"y": nm.structural_clean(F.col("x"))}, "name_texts", {"y": d.structural_clean("x")})
    scalar("c06_blocklist_key", name_texts, lambda: {"y": nm.blocklist_key(F.col("x"))}, "name_texts",
           {"y": d.strip(d.rr(d.rr(d.structural_clean("x"), r"[\-/,.]+", " "), r"\s+", " "))})
    scalar("c07_title_fallback", name_texts, lambda: {"y": nm.title_fallback(F.col("x"))}, "name_texts", {"y": d.title_fallback("x")})
    scalar("c08_display_name", name_texts, lambda: {"y": nm.display_name(F.col("x"))}, "name_texts", {"y": d.display_name("x")})
    query("c09_normalize_test_name",
          'SELECT r."Test_Name" AS x, count(*) AS n, any_value(n.test_name) AS y FROM lab_records r JOIN name_map n '
          f"ON n.raw = {d.strip('r.\"Test_Name\"')} GROUP BY 1", "lab_records", "name_map")(
        lambda spark, sf: column_of("Test_Name")(spark, sf).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        .select("x", "n", nm.normalize_test_name(F.col("x")).alias("y")))
    query("c10_client_test_name",
          'SELECT r."Test_Name" AS x, count(*) AS n, any_value(n.name) AS y FROM lab_records r JOIN client_names n '
          f"ON n.raw = {d.strip('r.\"Test_Name\"')} GROUP BY 1", "lab_records", "client_names")(
        lambda spark, sf: column_of("Test_Name")(spark, sf).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        .select("x", "n", nm.client_test_name(F.col("x")).alias("y")))
    query("c11_canonical_category",
          'SELECT r."Test_Category" AS x, count(*) AS n, any_value(c.category) AS y FROM lab_records r JOIN cat_map c '
          'ON c.raw IS NOT DISTINCT FROM r."Test_Category" GROUP BY 1', "lab_records", "cat_map")(
        lambda spark, sf: column_of("Test_Category")(spark, sf).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        .select("x", "n", nm.canonical_category(F.col("x")).alias("y")))
    scalar("c12_normalize_status", status_texts, lambda: {"y": st.normalize_status(F.col("x")), "client": st.client_status(F.col("x"))},
           "status_texts", {"y": d.normalize_status("x"), "client": d.client_status("x")})
    scalar("c13_canonical_status", status_texts, lambda: {"y": st.canonical_status(F.col("x"))}, "status_texts", {"y": d.canonical_status("x")})
    up = lambda v: v
    scalar("c14_standardize_value", column_of("Unit"),
           lambda: {"titled": nm.standardize(F.col("x"), fv.UNIT_PATTERNS, "title"), "lowered": nm.standardize(F.col("x"), fv.UNIT_PATTERNS, "lower"),
            "kept": nm.standard_unit(F.col("x"))}, "x_unit",
           {"titled": d.patterns(d.strip("x"), fv.UNIT_PATTERNS, str.title, d.title(d.strip("x"))),
            "lowered": d.patterns(d.strip("x"), fv.UNIT_PATTERNS, str.lower, f"lower({d.strip('x')})"),
            "kept": d.patterns(d.strip("x"), fv.UNIT_PATTERNS, up, d.strip("x"))})
    scalar("c15_pattern_maps", name_texts,
           lambda: {"name": nm.standard_test_name(F.col("x")), "unit": nm.standard_unit(F.col("x")), "status": nm.standard_status(F.col("x"))}, "name_texts",
           {"name": d.patterns(d.strip("x"), fv.TEST_NAME_PATTERNS, str.title, d.title(d.strip("x"))),
            "unit": d.patterns(d.strip("x"), fv.UNIT_PATTERNS, up, d.strip("x")),
            "status": d.patterns(d.strip("x"), fv.STATUS_PATTERNS, str.title, d.title(d.strip("x")))})
    scalar("c16_normalize_person", column_of("Patient_Name"), lambda: {"y": tx.normalize_person(F.col("x"))}, "x_patient_name", {"y": d.person("x")})


def register_texts() -> None:
    other = "'Ravi Kumar rao'"
    scalar("c17_persons_match", column_of("Patient_Name"),
           lambda: {"y": tx.persons_match(tx.normalize_person(F.col("x")), tx.normalize_person(F.lit("Ravi Kumar rao")))},
           "x_patient_name", {"y": d.persons_match(d.person("x"), d.person(other))})
    scalar("c18_file_key", url_texts, lambda: {"name": tx.file_key(F.col("x")), "stem": tx.file_stem(tx.file_key(F.col("x")))}, "url_texts",
           {"name": d.file_key("x"), "stem": d.file_stem(d.file_key("x"))})
    scalar("c19_patient_from_export_name",
           lambda s, f: column_of("Patient_Name")(s, f).select(F.concat(F.lit("Medical_Report_2024_"), F.translate(F.col("x"), " ", "_"), F.lit(".csv")).alias("x")),
           lambda: {"y": tx.patient_from_export_name(F.col("x"))},
           "x_export", {"y": f"coalesce({d.title(EXPORTED)}, 'N/A')"})
    scalar("c20_clean_lab", column_of("Lab_Name"), lambda: {"y": tx.clean_lab(F.col("x"))}, "x_lab_name", {"y": d.clean_lab("x")})
    scalar("c21_grouping_name", name_texts, lambda: {"y": nm.grouping_name(F.col("x"))}, "name_texts", {"y": d.grouping_name("x")})
    scalar("c22_chat_key", name_texts, lambda: {"y": nm.chat_key(F.col("x"))}, "name_texts", {"y": d.chat_key("x")})
    scalar("c23_chat_severity", status_texts, lambda: {"y": st.chat_severity(F.col("x"))}, "status_texts", {"y": d.chat_severity("x")})
    scalar("c24_severity_rank", status_texts,
           lambda: {"severity": st.severity3(F.col("x")), "severity_rank": st.severity3_rank(st.severity3(F.col("x"))), "tree_rank": st.tree_rank(F.col("x"))},
           "status_texts",
           {"severity": d.severity3("x"),
            "severity_rank": f"CASE {d.severity3('x')} WHEN 'HIGH' THEN 3 WHEN 'BORDERLINE' THEN 2 ELSE 1 END",
            "tree_rank": "CASE WHEN lower(x) = 'critical' THEN 0 WHEN lower(x) IN ('high','positive','flagged') THEN 1 "
                         "WHEN lower(x) IN ('low','insufficient') THEN 2 WHEN lower(x) IN ('normal','negative') THEN 3 ELSE 4 END"})
    scalar("c25_query_tokens", chat_texts, lambda: {"norm": tx.query_text(F.col("x")), "tokens": J(tx.query_tokens(F.col("x")))}, "chat_texts",
           {"norm": d.query_text("x"), "tokens": DJ(d.query_tokens("x"))})
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_list(v)}" for k, v in fv.CONCEPT_EXPANSIONS.items())
    added = f"flatten(list_transform({d.query_tokens('x')}, lambda c_: CASE c_ {cases} ELSE [] END))"
    scalar("c26_concept_expansion", question_texts, lambda: {"y": J(F.array_sort(tx.expanded_tokens(tx.query_tokens(F.col("x")))))},
           "question_texts", {"y": DJ(f"list_sort(list_distinct(list_concat({d.query_tokens('x')}, {added})))")})
    low = "lower(coalesce(x, ''))"
    sec = "nullif(regexp_extract(x, '(?i)retry in\\s+([\\d\\.]+)s', 1), '')"
    ms = "nullif(regexp_extract(x, '(?i)retry in\\s+([\\d\\.]+)ms', 1), '')"
    s_ = f"coalesce(try_cast({sec} AS DOUBLE), try_cast({ms} AS DOUBLE) / 1000.0)"
    lab = lambda q, u: f"CAST(CAST(round_even({s_} / {q}, 0) AS BIGINT) AS VARCHAR) || '{u}'"
    scalar("c27_rate_limit", failure_texts,
           lambda: {"is_error": tx.is_rate_limit_error(F.col("x")), "is_reason": tx.is_rate_limit_reason(F.col("x")), "delay": tx.retry_delay(F.col("x"))},
           "failure_texts",
           {"is_error": f"contains({low}, '429') OR contains({low}, 'quota exceeded') OR contains({low}, 'rate limit')",
            "is_reason": f"contains({low}, 'rate limit') OR contains({low}, 'quota') OR contains({low}, ' 429') OR contains({low}, ':429')",
            "delay": f"CASE WHEN {s_} < 1 THEN '<1s' WHEN {s_} < 120 THEN {lab(1, 's')} WHEN {s_} < 7200 THEN {lab(60, 'm')} "
                     f"WHEN {s_} < 172800 THEN {lab(3600, 'h')} WHEN {s_} IS NOT NULL THEN {lab(86400, 'd')} "
                     f"WHEN {sec} IS NOT NULL THEN {sec} || 's' WHEN {ms} IS NOT NULL THEN {ms} || 'ms' END"})

    def chunks(spark, sf):
        c = table(spark, sf, "conversations")
        return c.select("conv_id", "turn", F.posexplode(tx.answer_chunks(F.col("text"))).alias("pos", "chunk"))

    joined = "CASE WHEN open = '' THEN s ELSE open || ' ' || s END"
    flushed = "CASE WHEN open = '' THEN done ELSE list_append(done, open) END"
    query("c28_answer_chunks", f"""WITH RECURSIVE said AS (
        SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda s_: s_ <> '') AS parts FROM conversations
      ), walk AS (
        SELECT conv_id, turn, parts, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS open FROM said
        UNION ALL
        SELECT conv_id, turn, parts, i + 1,
          CASE WHEN length({joined}) <= 140 THEN done WHEN length(s) <= 140 THEN {flushed} ELSE list_concat({flushed}, list_transform(range(0, CAST(ceil(length(s) / 140.0) AS BIGINT)), lambda k_: substring(s, k_ * 140 + 1, 140))) END,
          CASE WHEN length({joined}) <= 140 THEN {joined} WHEN length(s) <= 140 THEN s ELSE '' END
        FROM (SELECT *, parts[i] AS s FROM walk WHERE i <= len(parts))
      ), whole AS (SELECT conv_id, turn, {flushed} AS chunks FROM walk WHERE i = len(parts) + 1)
      SELECT conv_id, turn, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS pos, unnest(chunks) AS chunk FROM whole""")(chunks)
    body = "CASE turn % 3 WHEN 0 THEN text || chr(13) || chr(10) || '**Sources:** [A](u)' WHEN 1 THEN text || chr(10) || 'sources: none' ELSE text END"

    def with_sources(spark, sf):
        c = table(spark, sf, "conversations")
        k = F.col("turn") % 3
        msg = (F.when(k == 0, F.concat("text", F.lit("\r\n**Sources:** [A](u)")))
               .when(k == 1, F.concat("text", F.lit("\nsources: none"))).otherwise(F.col("text")))
        s = c.select("conv_id", "turn", tx.split_sources(msg).alias("s"))
        return s.select("conv_id", "turn", F.col("s.body").alias("body"), F.col("s.sources").alias("sources"))

    pat = "(?im)^(?:\\*\\*)?Sources:(?:\\*\\*)?"
    query("c29_split_sources",
          f"""SELECT conv_id, turn, CASE WHEN p > 0 THEN {d.strip('left(t, p - 1)')} ELSE t END AS body,
          CASE WHEN p > 0 THEN {d.strip('substr(t, p)')} END AS sources FROM (SELECT conv_id, turn, t,
          CASE WHEN regexp_matches(t, '{pat}') THEN length(regexp_split_to_array(t, '{pat}')[1]) + 1 ELSE 0 END AS p
          FROM (SELECT conv_id, turn, {d.strip(f"replace({body}, chr(13) || chr(10), chr(10))")} AS t FROM conversations))""")(with_sources)

    def profile_names(spark, sf):
        c = table(spark, sf, "customer")
        shown = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_name")))
        mail = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit(".x"), F.col("c_custkey").cast("string"), F.lit("@mail.org")))
        return c.select("c_custkey", tx.self_profile_name(shown, mail).alias("profile_name"))

    local = "lower(c_mktsegment) || '.x' || CAST(c_custkey AS VARCHAR)"
    query("c30_self_profile_name",
          f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN trim(c_name) WHEN 1 THEN {d.title(f'replace({local}, chr(46), chr(32))')} ELSE 'My Profile' END AS profile_name FROM customer")(profile_names)

    def pick(spark, sf):
        r = lab_records(spark, sf)
        return r.groupBy("scope_id").agg(
            F.min_by(F.trim("Test_Name"), F.struct(-nm.name_score(F.trim("Test_Name")), "row_ord")).alias("picked"))

    query("c31_pick_canonical_name",
          f'SELECT scope_id, arg_min(trim("Test_Name"), ROW(-({d.name_score(chr(116) + chr(110))}), row_ord)) AS picked FROM (SELECT *, trim("Test_Name") AS tn FROM lab_records) GROUP BY 1',
          "lab_records")(pick)
    query("c32_completeness",
          f"SELECT scope_id, {d.completeness()} AS score, count(*) AS n FROM lab_records GROUP BY ALL", "lab_records")(
        lambda s, f: lab_records(s, f).groupBy("scope_id", va.completeness(F.col("Result"), F.col("Reference_Range"), F.col("Unit"), F.col("Status")).alias("score")).agg(F.count(F.lit(1)).alias("n")))

    def metric_grades(spark, sf):
        m = metrics(spark, sf)
        return m.groupBy("metric_name", st.metric_status(F.col("metric_name"), F.col("value")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))

    from labtrail.catalog.metrics_view import grade_sql, metrics

    query("c33_metric_status", f"SELECT metric_name, {grade_sql('metric_name', 'value')} AS grade, count(*) AS n FROM metrics GROUP BY ALL", "metrics")(metric_grades)
    scalar("c34_lower_is_better", name_texts, lambda: {"y": nm.lower_is_better(F.col("x"))}, "name_texts", {"y": d.lower_better("x")})

    def ages(spark, sf):
        o = table(spark, sf, "orders")
        day, end = F.to_date("o_orderdate"), F.add_months(F.to_date("o_orderdate"), F.lit(3))
        as_of = F.lit("1998-06-01").cast("date")
        return o.select("o_orderkey", tx.relative_age(day, as_of).alias("age"),
                        tx.range_label(F.when(F.col("o_orderkey") % 4 > 0, day), F.when(F.col("o_orderkey") % 3 > 0, end)).alias("label"))

    dd = "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01')"
    mm = f"CAST(floor({dd} / 30) AS BIGINT)"
    a_, b_ = "CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%b %Y') END", "CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate + INTERVAL 3 MONTH, '%b %Y') END"
    query("c35_date_labels",
          f"""SELECT o_orderkey, CASE WHEN {dd} <= 0 THEN 'Today' WHEN {dd} = 1 THEN '1 day ago' WHEN {dd} < 30 THEN {dd} || ' days ago'
          WHEN {mm} = 1 THEN '1 month ago' ELSE {mm} || ' months ago' END AS age,
          CASE WHEN ({a_}) IS NULL AND ({b_}) IS NULL THEN 'No reports yet' WHEN ({a_}) IS NOT NULL AND ({b_}) IS NOT NULL
          THEN ({a_}) || ' - ' || ({b_}) ELSE coalesce({a_}, {b_}) END AS label FROM orders""")(ages)


SQL.add("x_export", "SELECT 'Medical_Report_2024_' || replace(x, ' ', '_') || '.csv' AS x FROM x_patient_name", "x_patient_name")


def register_values() -> None:
    scalar("m01_parse_numeric", column_of("Result"), lambda: {"y": va.parse_numeric(F.col("x"))}, "x_result", {"y": d.parse_numeric("x")})
    scalar("m02_strict_numeric", column_of("Result"), lambda: {"y": va.strict_numeric(F.col("x"))}, "x_result", {"y": d.strict_numeric("x")})
    scalar("m03_leading_numeric", column_of("Result"), lambda: {"y": va.leading_numeric(F.col("x"))}, "x_result", {"y": d.leading_numeric("x")})
    scalar("m04_date_day_first", loose_texts, lambda: {"y": va.parse_date_day_first(F.col("x"))}, "loose_texts", {"y": d.date_day_first("x")})
    scalar("m05_sort_date", date_texts, lambda: {"y": va.parse_sort_date(F.col("x"))}, "date_texts", {"y": d.sort_date("x")})
    scalar("m06_report_date", date_texts, lambda: {"y": va.parse_report_date(F.col("x"))}, "date_texts", {"y": d.report_date("x")})
    scalar("m07_client_date", date_texts, lambda: {"y": va.parse_client_date(F.col("x"))}, "date_texts", {"y": d.client_date("x")})
    scalar("m08_format_date", column_of("Test_Date"), lambda: {"y": va.format_day_first(va.parse_date_day_first(F.col("x")))}, "x_test_date",
           {"y": d.fmt_date(d.date_day_first("x"))})
    query("m09_infer_report_date",
          f"""SELECT report_id, coalesce(arg_min(dt, row_ord) FILTER (WHERE dt IS NOT NULL), DATE '1999-01-01') AS report_date
          FROM (SELECT *, {d.report_date('"Test_Date"')} AS dt FROM lab_records) GROUP BY 1""", "lab_records")(
        lambda s, f: infer_dates(lab_records(s, f)))
    rr = lambda k: va.reference_range(F.col("x"))[k]
    scalar("m10_reference_range", column_of("Reference_Range"), lambda: {"low": rr("low"), "high": rr("high"), "kind": rr("kind")},
           "x_reference_range", {"low": d.range_low("x"), "high": d.range_high("x"), "kind": d.range_kind("x")})
    cr = lambda k: va.client_range(F.col("x"))[k]
    scalar("m11_client_range", column_of("Reference_Range"), lambda: {"low": cr("low"), "high": cr("high")},
           "x_reference_range", {"low": d.client_low("x"), "high": d.client_high("x")})

    def dev(spark, sf):
        r = lab_records(spark, sf)
        c = va.client_range(F.col("Reference_Range"))
        r = r.select("row_ord", va.leading_numeric(F.col("Result")).alias("v"), c["low"].alias("lo"), c["high"].alias("hi"), st.severity3(F.col("Status")).alias("sev"))
        return r.select("row_ord", va.deviation_percent(F.col("v"), F.col("lo"), F.col("hi"), F.col("sev")).alias("deviation"),
                        F.round(va.trend_threshold(F.col("lo"), F.col("hi"), F.col("v")), 6).alias("threshold"))

    src = f"""(SELECT row_ord, {d.leading_numeric('"Result"')} AS v, {d.client_low('"Reference_Range"')} AS lo,
      {d.client_high('"Reference_Range"')} AS hi, {d.severity3('"Status"')} AS sev FROM lab_records)"""
    thr = ("round(CASE WHEN abs(hi - lo) > 0 THEN abs(hi - lo) * 0.05 WHEN hi IS NOT NULL AND hi <> 0 THEN abs(hi) * 0.05 "
           "WHEN lo IS NOT NULL AND lo <> 0 THEN abs(lo) * 0.05 ELSE greatest(abs(v) * 0.05, 0.5) END, 6)")
    query("m12_deviation_percent", f"SELECT row_ord, {d.deviation('v', 'lo', 'hi', 'sev')} AS deviation FROM {src}", "lab_records")(lambda s, f: dev(s, f).drop("threshold"))
    query("m13_trend_threshold", f"SELECT row_ord, {thr} AS threshold FROM {src}", "lab_records")(lambda s, f: dev(s, f).drop("deviation"))
    upd = "CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '-' || strftime(o_orderdate, '%m') ELSE '' END"
    age = f"date_diff('day', CASE WHEN o_orderkey % 2 = 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE make_date(year(o_orderdate), 1, 1) END, DATE '1999-01-01') / 30.0"

    def recency(spark, sf):
        o = table(spark, sf, "orders")
        text = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), F.date_format("o_orderdate", "MM"))).otherwise(""))
        return o.select("o_orderkey", text.alias("updated"), va.recency_score(text, F.lit("1999-01-01").cast("date")).alias("score"))

    query("m16_recency_score", f"SELECT o_orderkey, {upd} AS updated, CASE WHEN {age} <= 12 THEN 3 WHEN {age} <= 24 THEN 2 WHEN {age} <= 36 THEN 1 ELSE 0 END AS score FROM orders")(recency)
    parts = "string_split(x, ' ')"
    scalar("m17_unique_strings", chat_texts, lambda: {"y": J(va.unique_strings(F.split(F.col("x"), " ")))}, "chat_texts",
           {"y": DJ(f"""list_transform(list_filter(list_transform(range(1, len({parts}) + 1), lambda u_: {{'i': u_, 'v': {d.strip(parts + '[u_]')}}}),
             lambda o_: o_.v <> '' AND list_position(list_transform({parts}, lambda z_: {d.strip('z_')}), o_.v) = o_.i), lambda r_: r_.v)""")})

    def alias_json(spark, sf):
        p = table(spark, sf, "part")
        k, n = F.col("p_partkey") % 4, F.col("p_name")
        j = (F.when(k == 0, F.concat(F.lit('["'), n, F.lit(' ", "'), n, F.lit('", "x"]'))).when(k == 1, F.concat(F.lit('"'), n, F.lit('"')))
             .when(k == 2, F.concat(F.lit(" "), n)).otherwise(F.lit("17")))
        return p.select("p_partkey", J(va.coerce_aliases(j)).alias("aliases"))

    query("m18_coerce_aliases", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '|x' WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE '' END AS aliases FROM part")(alias_json)

    def json_objects(spark, sf):
        c = table(spark, sf, "conversations")
        obj = F.to_json(F.struct("conv_id", "turn", F.struct(F.col("text").alias("t")).alias("body")))
        k = F.col("turn") % 3
        reply = (F.when(k == 0, F.concat(F.lit("Here: "), obj, F.lit(" } done {")))
                 .when(k == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct("conv_id", "turn")), F.lit("\n``` {}"))).otherwise(F.concat(F.lit("none { "), F.lit('"a": "}"'))))
        return c.select("conv_id", "turn", tx.first_json_object(reply).alias("json"))

    query("m19_first_json_object", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(to_json({'conv_id': conv_id, 'turn': turn, 'body': {'t': text}}) AS VARCHAR)
      WHEN 1 THEN CAST(to_json({'conv_id': conv_id, 'turn': turn}) AS VARCHAR) END AS json FROM conversations""")(json_objects)
    query("m20_row_signature", 'SELECT count(*) AS rows, count(DISTINCT ("Test_Name", "Test_Date", "Result", "Unit", "Status", "Patient_ID")) AS signatures FROM lab_records', "lab_records")(
        lambda s, f: lab_records(s, f).select(va.signature("Test_Name", "Test_Date", "Result", "Unit", "Status", "Patient_ID").alias("k"))
        .groupBy("k").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("signatures")))


def infer_dates(r: DataFrame) -> DataFrame:
    dt = va.parse_report_date(F.col("Test_Date"))
    return r.groupBy("report_id").agg(
        F.coalesce(F.min_by(dt, F.when(dt.isNotNull(), F.col("row_ord"))), F.lit("1999-01-01").cast("date")).alias("report_date"))


def register() -> None:
    register_names()
    register_texts()
    register_values()
