"""Lab-shaped views over the driver's tables, in Spark and in DuckDB SQL.

The driver's tables hold no laboratory data.  Each view is written twice, once
per engine, from the shared lists below, using only modulo, list indexing and
concatenation, so both engines see the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labtrail.session import shuffle_width

TEST_ALIASES = [
    "SGOT", "Aspartate Aminotransferase (AST)", "HbA1c", "haemoglobin a1c",
    "Vitamin B-12", " vitamin  b12 ", "LDL", "LDL Cholesterol (Serum)", "TSH",
    "Thyroid Stimulating Hormone (TSH)", "Creatinine", "Serum Creatinine", "Albumin",
    "Albumin/Globulin Ratio (A/G Ratio)", "Bilirubin Total", "Bilirubin - Direct",
    "Haemoglobin (Hb)", "hemoglobin", "Lymphocytes %", "Lymphocytes - Absolute Count",
    "Zinc Level", "zinc   level (serum)", "C-Peptide (fasting)", "N/A",
]
RAW_CATEGORIES = [
    "Liver Function Test", "Hematology Panel", None, "lipid", "Thyroid Profile",
    "Unmapped Thing", "Diabetes / Glucose Metabolism", "N/A", "Serum Electrolytes", "???",
    " Vitamins & Minerals ",
]
LABS = [
    "City Lab", "Apollo Diagnostics - Billing Center", "Metro|Invoice 42", "N/A",
    "Sunrise Pathology, Pune", "Care (Home) Collection Centre", "LabOne",
]
UNITS = ["mg/dl", "IU/L", "%", "", "gm/dl", "ng/mL"]
RANGES = ["10 - 40", "< 30", "> 5", "Negative", "N/A", ""]
TEXT_RESULTS = ["Detected", "Not Detected", "12 mg", "trace"]
STATUSES = [
    "Normal", "High", "LOW", "Critical", "within range", "Abnormal", "Positive", "negative",
    "Borderline High", "flagged", "Insufficient", "N/A", None, "reactive", "Panic value",
    "see note", "Low", "High",
]
FIRST_NAMES = ["asha", "RAVI", "Meena", "john", "Li"]
LAST_NAMES = ["Kumar", "rao", "SMITH", "Devi Nair", "Chen", "o'neil", "Das"]
TITLES = ["", "Mr. ", "Dr ", "MS. "]
GENDERS = ["Male", "Female", "N/A", "F"]


def pick(values: list, index: Column) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


# --- Spark ------------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _lines(spark: SparkSession, sf: str, **of_order: Column) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus",
    )
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", *[c.alias(n) for n, c in of_order.items()])
    return li.join(od, li.l_orderkey == od.o_orderkey)


def lab_records(spark: SparkSession, sf: str) -> DataFrame:
    return _as_records(_lines(spark, sf).withColumn("study_id", _study()))


def records_by_report(spark: SparkSession, sf: str) -> DataFrame:
    """``lab_records`` with the rows of a report in one task, for those who make
    documents of them: the lines meet while they are narrow.  ``first_day`` is
    the first date of the report's order."""
    first = F.min("o_orderdate").over(Window.partitionBy("o_orderkey"))
    lines = _lines(spark, sf, first_day=first).withColumns({"study_id": _study(), "report_id": F.col("l_orderkey")})
    met = lines.repartition(shuffle_width(lines), "study_id", "report_id")
    return _as_records(met, "first_day")


def _study() -> Column:
    return F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"))


def _as_records(j: DataFrame, *more: str) -> DataFrame:
    d = F.col("o_orderdate")
    qty = F.col("l_quantity").cast("int")
    status_ix = (
        F.col("l_linenumber") % 3
        + 3 * F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
        + 6 * F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    )
    test_date = (
        F.when(F.col("l_orderkey") % 5 == 0, F.date_format(d, "dd-MM-yyyy"))
        .when(F.col("l_orderkey") % 5 == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(F.col("l_orderkey") % 5 == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("l_orderkey") % 5 == 3, F.date_format(d, "d-M-yy"))
        .otherwise("N/A")
    )
    result = (
        F.when(F.col("l_linenumber") % 7 == 0, pick(TEXT_RESULTS, qty % 4))
        .when(F.col("l_linenumber") % 7 == 1, F.concat(F.lit("1,"), _pad(qty, 3)))
        .otherwise(F.concat(qty.cast("string"), F.lit("."), (F.col("l_suppkey") % 10).cast("string")))
    )
    return j.select(
        F.col("o_custkey").cast("string").alias("scope_id"),
        "study_id", (F.col("report_id") if "report_id" in j.columns else F.col("l_orderkey")).alias("report_id"),
        F.concat(
            _pad(F.col("l_orderkey"), 12), F.lit("."), F.col("l_linenumber").cast("string"),
            F.lit("."), _pad(F.col("l_partkey"), 10), F.lit("."), _pad(F.col("l_suppkey"), 10),
            F.lit("."), _pad(qty, 3), F.lit("."),
            _pad(F.round(F.col("l_extendedprice") * 100).cast("bigint"), 12),
        ).alias("row_ord"),
        F.concat(F.lit("report_"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("Source_Filename"),
        F.col("o_custkey").cast("string").alias("Patient_ID"),
        F.concat(
            pick(TITLES, F.col("l_orderkey") % 4), pick(FIRST_NAMES, F.col("o_custkey") % 5),
            F.lit(" "), pick(LAST_NAMES, F.col("o_custkey") % 7),
        ).alias("Patient_Name"),
        (F.col("o_custkey") % 60 + F.year(d) - 1975).cast("string").alias("Age"),
        pick(GENDERS, F.col("o_custkey") % 4).alias("Gender"),
        test_date.alias("Test_Date"),
        pick(LABS, F.col("l_suppkey") % 7).alias("Lab_Name"),
        pick(RAW_CATEGORIES, F.col("l_partkey") % 11).alias("Test_Category"),
        pick(TEST_ALIASES, F.col("l_partkey") % 24).alias("Original_Test_Name"),
        pick(TEST_ALIASES, F.col("l_partkey") % 24).alias("Test_Name"),
        result.alias("Result"),
        pick(UNITS, F.col("l_partkey") % 6).alias("Unit"),
        pick(RANGES, F.col("l_suppkey") % 6).alias("Reference_Range"),
        pick(STATUSES, status_ix).alias("Status"), *more,
    )


# --- DuckDB -----------------------------------------------------------------
def _sql_pick(values: list, index: str) -> str:
    return f"({sql_list(values)})[({index}) + 1]"


LAB_RECORDS_SQL = f"""
SELECT CAST(o_custkey AS VARCHAR) AS scope_id,
       CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS study_id,
       l_orderkey AS report_id,
       lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '.' || CAST(l_linenumber AS VARCHAR) || '.' ||
       lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '.' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || '.' ||
       lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') || '.' ||
       lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS row_ord,
       'report_' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS "Source_Filename",
       CAST(o_custkey AS VARCHAR) AS "Patient_ID",
       {_sql_pick(TITLES, 'l_orderkey % 4')} || {_sql_pick(FIRST_NAMES, 'o_custkey % 5')} || ' ' ||
       {_sql_pick(LAST_NAMES, 'o_custkey % 7')} AS "Patient_Name",
       CAST(o_custkey % 60 + year(o_orderdate) - 1975 AS VARCHAR) AS "Age",
       {_sql_pick(GENDERS, 'o_custkey % 4')} AS "Gender",
       CASE l_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y')
            WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 3 THEN strftime(o_orderdate, '%-d-%-m-%y') ELSE 'N/A' END AS "Test_Date",
       {_sql_pick(LABS, 'l_suppkey % 7')} AS "Lab_Name",
       {_sql_pick(RAW_CATEGORIES, 'l_partkey % 11')} AS "Test_Category",
       {_sql_pick(TEST_ALIASES, 'l_partkey % 24')} AS "Original_Test_Name",
       {_sql_pick(TEST_ALIASES, 'l_partkey % 24')} AS "Test_Name",
       CASE WHEN l_linenumber % 7 = 0 THEN {_sql_pick(TEXT_RESULTS, 'CAST(l_quantity AS INTEGER) % 4')}
            WHEN l_linenumber % 7 = 1 THEN '1,' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0')
            ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' || CAST(l_suppkey % 10 AS VARCHAR) END AS "Result",
       {_sql_pick(UNITS, 'l_partkey % 6')} AS "Unit",
       {_sql_pick(RANGES, 'l_suppkey % 6')} AS "Reference_Range",
       {_sql_pick(STATUSES, "l_linenumber % 3 + 3 * (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) + 6 * (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)")} AS "Status"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


class SqlViews:
    """Named SQL views with dependencies, expanded into one WITH clause."""

    def __init__(self) -> None:
        self.views: dict[str, tuple[str, list[str]]] = {}

    def add(self, name: str, sql: str, *deps: str) -> None:
        self.views[name] = (sql.strip(), list(deps))

    def _order(self, names: list[str]) -> list[str]:
        def visit(seen: list[str], name: str) -> list[str]:
            if name in seen:
                return seen
            return reduce(visit, self.views[name][1], seen) + [name]

        out: list[str] = []
        for n in names:
            for v in visit(out, n)[len(out):]:
                out.append(v)
        return out

    def query(self, body: str, *names: str) -> str:
        ordered = self._order(list(names))
        if not ordered:
            return body.strip()
        ctes = ",\n".join(
            f"{n} AS {'MATERIALIZED ' if n in MATERIALIZE else ''}({self.views[n][0]})" for n in ordered
        )
        recursive = "RECURSIVE " if "reach" in ordered else ""
        return f"WITH {recursive}{ctes}\n{body.strip()}"


MATERIALIZE = {"lab_records", "normalized", "resolved"}
SQL = SqlViews()
SQL.add("lab_records", LAB_RECORDS_SQL)
