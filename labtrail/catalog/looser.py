"""Looser grouping of test names."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.catalog import duck as d
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records, sql_list, sql_text
from labtrail.functions import names as nm
from labtrail.functions.basic import n_rows
from labtrail.operators import looser as lo
from labtrail.operators import unify as un

QUALIFIER_WORDS = ["Total", "Direct", "Serum Level", "%", "Absolute Count", "/ Ratio", "(Blood)"]


def vocabulary(s, f):
    """Every name of the records, plain and with a qualifier behind it."""
    names = lab_records(s, f).select(F.col("Original_Test_Name").alias("name")).where("name <> 'N/A'").distinct()
    more = names.withColumn("name", F.explode(F.array(F.col("name"), *[F.concat_ws(" ", "name", F.lit(q)) for q in QUALIFIER_WORDS])))
    return more.select(nm.structural_clean(F.col("name")).alias("key")).distinct()


SQL.add("vocab", f"""SELECT DISTINCT {d.structural_clean('name')} AS key FROM (SELECT DISTINCT "Original_Test_Name" || q AS name FROM lab_records, (SELECT unnest({sql_list([''] + [' ' + q for q in QUALIFIER_WORDS])}) AS q) WHERE "Original_Test_Name" <> 'N/A')""", "lab_records")


def _parts(x):
    return f"list_filter(string_split_regex({x}, '[\\s\\-/,.]+'), lambda w_: w_ <> '')"


def facts_view(name, source):
    """The facts of each key that the rule compares."""
    long = f"list_filter({_parts('key')}, lambda w_: length(w_) > 2)"
    qualifier = "CASE " + " ".join(f"WHEN contains(key, '{q}') THEN '{q}'" for q in lo.BILIRUBIN) + " ELSE '' END"
    SQL.add(name, f"""SELECT key, contains(key, 'ratio') OR contains(key, '/') AS ratio, contains(key, 'percent') OR key LIKE '%\\%' ESCAPE '\\' AS pct, regexp_matches(key, 'absolute|count|x10') AS abso,
      contains(key, 'bilirubin') AS bili, {qualifier} AS qual, regexp_replace(key, '[\\s\\-/,.]+', '', 'g') AS comp, array_to_string(list_transform({_parts('key')}, lambda w_: left(w_, 1)), '') AS init,
      {long} AS ws, trim(regexp_replace(regexp_replace(key, '[\\-/,.]+', ' ', 'g'), '\\s+', ' ', 'g')) AS bk FROM {source}""", source)


facts_view("vocab_facts", "vocab")
_never = [[x.replace("-", " ").replace("/", " ").replace(",", " ").replace(".", " ") for x in pair] for pair in fv.MUST_NOT_MERGE]
SQL.add("never", "SELECT * FROM (VALUES " + ", ".join(f"({sql_text(p)}, {sql_text(q)})" for p, q in _never) + ") AS t(p, q)")
# a side of a pair in the one key and the other side in the other: which key is shorter makes no difference
SAME = """NOT EXISTS (SELECT 1 FROM never n WHERE (contains(x.bk, n.p) AND contains(y.bk, n.q)) OR (contains(x.bk, n.q) AND contains(y.bk, n.p)))
  AND x.ratio = y.ratio AND NOT (x.pct AND y.abso) AND NOT (y.pct AND x.abso) AND NOT (x.bili AND y.bili AND x.qual <> y.qual)
  AND (x.comp = y.init OR y.comp = x.init OR x.comp = y.comp
    OR (len(x.ws) >= 2 AND len(y.ws) >= 2 AND len(list_intersect(x.ws, y.ws)) / least(len(list_distinct(x.ws)), len(list_distinct(y.ws))) >= 0.8)
    OR (least(length(x.key), length(y.key)) >= 8 AND (starts_with(x.key, y.key) OR starts_with(y.key, x.key))))"""
SQL.add("vocab_pairs", f"SELECT x.key AS a, y.key AS b FROM vocab_facts x JOIN vocab_facts y ON x.key < y.key WHERE {SAME}", "vocab_facts", "never")
SQL.add("record_keys", f"SELECT DISTINCT {d.structural_clean('n')} AS key, n AS name FROM (SELECT DISTINCT \"Test_Name\" AS n FROM normalized)", "normalized")
SQL.add("key_list", "SELECT DISTINCT key FROM record_keys", "record_keys")
facts_view("key_facts", "key_list")
SQL.add("key_pairs", f"SELECT x.key AS a, y.key AS b FROM key_facts x JOIN key_facts y ON x.key <> y.key WHERE {SAME}", "key_facts", "never")
SQL.add("scope_keys", 'SELECT DISTINCT r.scope_id, k.key FROM normalized r JOIN record_keys k ON k.name = r."Test_Name"', "normalized", "record_keys")
SQL.add("scope_edges", "SELECT s.scope_id, s.key AS a, t.key AS b FROM scope_keys s JOIN key_pairs p ON p.a = s.key JOIN scope_keys t ON t.scope_id = s.scope_id AND t.key = p.b", "scope_keys", "key_pairs")
SQL.add("reach", "SELECT scope_id, key AS a, key AS b FROM scope_keys UNION SELECT r.scope_id, r.a, e.b FROM reach r JOIN scope_edges e ON e.scope_id = r.scope_id AND e.a = r.b", "scope_keys", "scope_edges")
SQL.add("looser", "SELECT scope_id, a AS key, min(b) AS label FROM reach GROUP BY 1, 2", "reach")


def register() -> None:
    query("p03_same_test_looser", "SELECT a, b FROM vocab_pairs", "vocab_pairs")(lambda s, f: lo.same_pairs(vocabulary(s, f)))
    query("p04_looser_groups", "SELECT scope_id, key, label FROM looser", "looser")(lambda s, f: lo.group_labels(lo.keyed(lab_records(s, f))))
    query("p04_looser_dedup", """SELECT scope_id, label_names, readings FROM (SELECT scope_id, count(DISTINCT label) AS label_names, count(DISTINCT (label, date_key)) AS readings FROM
      (SELECT r.scope_id, l.label, coalesce(nullif(trim(r."Test_Date"), ''), 'N/A') AS date_key FROM normalized r JOIN record_keys k ON k.name = r."Test_Name" JOIN looser l ON l.scope_id = r.scope_id AND l.key = k.key) GROUP BY 1)""", "normalized", "record_keys", "looser")(
        lambda s, f: lo.resolve_loosely(lab_records(s, f)).groupBy("scope_id").agg(F.countDistinct(F.array_join("Aliases", "|")).alias("label_names"), n_rows().alias("readings")))
    query("p06_unify_names")(lambda s, f: un.unify_names(lab_records(s, f)).select("row_ord", "Test_Name", "Test_Category", "Test_Date", "Result", "Patient_ID"))
    SQL.add("plain_names", f"""SELECT * REPLACE (CASE WHEN "Test_Name" IN ({', '.join(sql_text(x) for x in fv.B12_VARIANTS)}) THEN {sql_text(fv.B12_TARGET)} ELSE coalesce("Test_Name", 'N/A') END AS "Test_Name") FROM lab_records""", "lab_records")
    query("p06_name_facts", f"""SELECT "Test_Name" AS name, count(*) AS n, min(row_ord) AS first, round(quantile_cont({d.strict_numeric('"Result"')}, 0.5), 6) AS median FROM plain_names GROUP BY 1""", "plain_names")(
        lambda s, f: un.name_facts(un.with_plain_names(lab_records(s, f))).select("name", "n", "first", F.round("median", 6).alias("median")))
    query("p06_frequent_categories", """SELECT "Test_Name", arg_min("Test_Category", ROW(-n, "Test_Category")) AS category FROM (SELECT "Test_Name", "Test_Category", count(*) AS n FROM plain_names
      WHERE "Test_Category" IS NOT NULL AND "Test_Category" <> 'N/A' GROUP BY ALL) GROUP BY 1""", "plain_names")(lambda s, f: un.frequent_categories(un.with_plain_names(lab_records(s, f))).withColumnRenamed("_mode", "category"))
