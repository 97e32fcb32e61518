"""Patient details."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.catalog import duck as d
from labtrail.catalog.registry import query
from labtrail.catalog.views import SQL, lab_records
from labtrail.operators import patients as pt


def infos(spark, sf):
    """One patient line per report, some fields missing or conflicting."""
    r = lab_records(spark, sf).groupBy("scope_id", "report_id").agg(
        F.min("row_ord").alias("row_ord"),
        *[F.min_by(c, "row_ord").alias(n) for c, n in (("Patient_Name", "pn"), ("Age", "ag"), ("Gender", "gender"), ("Patient_ID", "patient_id"), ("Test_Date", "date"), ("Lab_Name", "lab_name"))])
    k = F.col("report_id")
    name = (F.when(k % 9 == 0, F.lit("N/A")).when(k % 50 == 7, F.lit("Zed Other")).when(k % 11 == 3, F.substring_index(F.col("pn"), " ", -1)).otherwise(F.col("pn")))
    return r.select("scope_id", "row_ord", name.alias("name"), F.when(k % 6 == 0, F.lit("N/A")).otherwise(F.col("ag")).alias("age"), "gender", "patient_id", "date", "lab_name", "report_id")


SQL.add("infos", """SELECT scope_id, row_ord, CASE WHEN report_id % 9 = 0 THEN 'N/A' WHEN report_id % 50 = 7 THEN 'Zed Other' WHEN report_id % 11 = 3 THEN string_split(pn, ' ')[-1] ELSE pn END AS name,
  CASE WHEN report_id % 6 = 0 THEN 'N/A' ELSE ag END AS age, gender, patient_id, date, lab_name, report_id FROM (SELECT scope_id, report_id, min(row_ord) AS row_ord, arg_min("Patient_Name", row_ord) AS pn, arg_min("Age", row_ord) AS ag,
  arg_min("Gender", row_ord) AS gender, arg_min("Patient_ID", row_ord) AS patient_id, arg_min("Test_Date", row_ord) AS date, arg_min("Lab_Name", row_ord) AS lab_name FROM lab_records GROUP BY 1, 2)""", "lab_records")


def info_views(p, src):
    """Votes and dated facts over one patient-line view."""
    for f in ("gender", "patient_id", "lab_name", "age"):
        SQL.add(f"{p}_{f}", f"SELECT scope_id, arg_min({f}, ROW(-n, o)) AS v FROM (SELECT scope_id, {f}, count(*) AS n, min(row_ord) AS o FROM {src} WHERE {f} NOT IN ('N/A', '') GROUP BY 1, 2) GROUP BY 1", src)
    SQL.add(f"{p}_nm", f"SELECT scope_id, row_ord, name, {d.person('name')} AS n FROM {src} WHERE name NOT IN ('N/A', '')", src)
    SQL.add(f"{p}_name", f"SELECT scope_id, arg_min(n, ROW(-c, -length(n), o)) AS v FROM (SELECT scope_id, n, count(*) AS c, min(row_ord) AS o FROM {p}_nm GROUP BY 1, 2) GROUP BY 1", f"{p}_nm")
    SQL.add(f"{p}_dated", f"""SELECT scope_id, arg_min(age, ROW(-date_diff('day', DATE '1970-01-01', dy), row_ord)) FILTER (WHERE dy IS NOT NULL AND age NOT IN ('N/A', '')) AS dated_age,
      arg_min(age, row_ord) FILTER (WHERE age NOT IN ('N/A', '')) AS first_age, max(dy) AS dy FROM (SELECT *, {d.date_day_first('date')} AS dy FROM {src}) GROUP BY 1""", src)


info_views("i", "infos")
SQL.add("infos_new", "SELECT * FROM infos WHERE report_id % 3 > 0", "infos")
SQL.add("infos_old", "SELECT * FROM infos WHERE report_id % 3 = 0", "infos")
info_views("n", "infos_new")
info_views("o", "infos_old")
CONS = """SELECT g.scope_id, coalesce(nm.v, 'N/A') AS name, coalesce(g.dated_age, ag.v, 'N/A') AS age, coalesce(ge.v, 'N/A') AS gender, coalesce(pi.v, 'N/A') AS patient_id,
  coalesce(strftime(g.dy, '%d-%m-%Y'), 'N/A') AS date, coalesce(lb.v, 'N/A') AS lab_name FROM {p}_dated g LEFT JOIN {p}_name nm USING (scope_id) LEFT JOIN {p}_age ag USING (scope_id)
  LEFT JOIN {p}_gender ge USING (scope_id) LEFT JOIN {p}_patient_id pi USING (scope_id) LEFT JOIN {p}_lab_name lb USING (scope_id)"""
for _p in "io":
    SQL.add(f"{_p}_cons", CONS.format(p=_p), *[f"{_p}_{x}" for x in ("dated", "name", "age", "gender", "patient_id", "lab_name")])
SQL.add("both_labs", """SELECT scope_id, arg_min(lab_name, ROW(-n, o)) AS v FROM (SELECT scope_id, lab_name, count(*) AS n, min(o) AS o FROM (SELECT scope_id, lab_name, row_ord AS o FROM infos_new
  UNION ALL SELECT scope_id, lab_name, '~' FROM o_cons) WHERE lab_name NOT IN ('N/A', '') GROUP BY 1, 2) GROUP BY 1""", "infos_new", "o_cons")
PERSON_A, PERSON_B = "a.n", "b.n"
SQL.add("name_pairs", f"""SELECT a.scope_id, arg_min(a.name, ROW(a.row_ord, b.row_ord)) AS first_name, arg_min(b.name, ROW(a.row_ord, b.row_ord)) AS conflicting_name FROM i_nm a JOIN i_nm b ON a.scope_id = b.scope_id AND a.row_ord < b.row_ord
  AND NOT {d.persons_match(PERSON_A, PERSON_B)} GROUP BY 1""", "i_nm")


def existing(s, f):
    return pt.consolidate(infos(s, f).where(F.col("report_id") % 3 == 0))


def register() -> None:
    query("e15_consolidate_patient", "SELECT * FROM i_cons", "i_cons")(lambda s, f: pt.consolidate(infos(s, f)))
    query("e16_smart_selection", "SELECT c.* REPLACE (CASE WHEN h.hd THEN c.age ELSE 'N/A' END AS age) FROM i_cons c JOIN (SELECT scope_id, bool_or(date NOT IN ('N/A', '')) AS hd FROM infos GROUP BY 1) h USING (scope_id)", "i_cons", "infos")(lambda s, f: pt.consolidate(infos(s, f), smart=True))
    merged = f"""SELECT scope_id, CASE WHEN g.scope_id2 IS NULL THEN o.name ELSE coalesce(nm.v, o.name, 'N/A') END AS name, CASE WHEN g.scope_id2 IS NULL THEN o.age ELSE coalesce(g.dated_age, g.first_age, o.age, 'N/A') END AS age,
      CASE WHEN g.scope_id2 IS NULL THEN o.gender ELSE coalesce(ge.v, o.gender, 'N/A') END AS gender, CASE WHEN g.scope_id2 IS NULL THEN o.patient_id ELSE coalesce(pi.v, o.patient_id, 'N/A') END AS patient_id,
      CASE WHEN g.scope_id2 IS NULL THEN o.date ELSE coalesce(strftime(greatest(g.dy, {d.date_day_first('o.date')}), '%d-%m-%Y'), 'N/A') END AS date,
      CASE WHEN g.scope_id2 IS NULL THEN o.lab_name ELSE coalesce(lb.v, 'N/A') END AS lab_name
      FROM o_cons o FULL JOIN (SELECT *, scope_id AS scope_id2 FROM n_dated) g USING (scope_id) LEFT JOIN n_name nm USING (scope_id) LEFT JOIN n_gender ge USING (scope_id)
      LEFT JOIN n_patient_id pi USING (scope_id) LEFT JOIN both_labs lb USING (scope_id)"""
    for key in ("e17_merge_existing_patient", "j17_existing_full_join"):
        query(key, merged, "o_cons", "n_dated", "n_name", "n_gender", "n_patient_id", "both_labs")(
            lambda s, f: pt.merge_with_existing(existing(s, f), infos(s, f).where(F.col("report_id") % 3 > 0)))
    mode = lambda c: f"(SELECT scope_id, arg_min(v, ROW(-n, v)) AS v FROM (SELECT scope_id, \"{c}\" AS v, count(*) AS n FROM lab_records WHERE \"{c}\" <> 'N/A' GROUP BY 1, 2) GROUP BY 1)"
    query("e18_patient_from_records", f"""SELECT g.scope_id, coalesce(a.v, 'N/A') AS name, coalesce(b.v, 'N/A') AS age, coalesce(c.v, 'N/A') AS gender, coalesce(e.v, 'N/A') AS patient_id, coalesce(h.v, 'N/A') AS lab_name,
      coalesce(strftime(g.dy, '%d-%m-%Y'), 'N/A') AS date FROM (SELECT scope_id, max({d.date_day_first('"Test_Date"')}) AS dy FROM lab_records GROUP BY 1) g LEFT JOIN {mode('Patient_Name')} a USING (scope_id)
      LEFT JOIN {mode('Age')} b USING (scope_id) LEFT JOIN {mode('Gender')} c USING (scope_id) LEFT JOIN {mode('Patient_ID')} e USING (scope_id) LEFT JOIN {mode('Lab_Name')} h USING (scope_id)""", "lab_records")(
        lambda s, f: pt.from_records(lab_records(s, f)))
    query("j10_name_conflicts", "SELECT * FROM name_pairs", "name_pairs")(lambda s, f: pt.name_conflicts(infos(s, f)))
    query("m21_most_common_or_latest", "SELECT g.scope_id, l.v AS lab_name, coalesce(strftime(g.dy, '%d-%m-%Y'), 'N/A') AS date FROM i_dated g LEFT JOIN i_lab_name l USING (scope_id)", "i_dated", "i_lab_name")(
        lambda s, f: pt.consolidate(infos(s, f)).select("scope_id", F.nullif(F.col("lab_name"), F.lit("N/A")).alias("lab_name"), "date"))
    query("w10_latest_dated_row", f"""SELECT scope_id, row_ord, name, age, gender, patient_id, date, lab_name, report_id FROM (SELECT *, {d.date_day_first('date')} AS dy FROM infos)
      WHERE dy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY dy DESC, row_ord) = 1""", "infos")(lambda s, f: pt.latest_line(infos(s, f)))
    for key in ("w09_age_on_latest_report",):
        query(key, "SELECT scope_id, dated_age, first_age, dy AS day FROM i_dated", "i_dated")(lambda s, f: pt.dated_facts(infos(s, f)).drop("has_date"))
