"""Small text building blocks shared by the other function modules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def n_rows() -> Column:
    return F.count(F.lit(1))


def na() -> Column:
    return F.lit("N/A")


def strip(c: Column) -> Column:
    """Trim every kind of white space (Spark's trim removes blanks only)."""
    return F.trim(c, F.lit(WHITESPACE))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, pattern, replacement)


def squeeze(c: Column) -> Column:
    return sub(c, r"\s+", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Keeps nested text functions from multiplying the size of the expression.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(df: DataFrame, keys: str | list[str], *order: Column | str) -> DataFrame:
    """Rows with ``place``, their number in their group's order.  Written tables
    have no order of their own; a place costs one shuffle by the group and no
    sampling, and readers sort by it what they show."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000_000))


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(
        F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000_000))
    )


def words(c: Column) -> Column:
    """Non-empty white-space separated words."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def title_case(c: Column) -> Column:
    """Upper-case every letter that does not follow a letter."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def _constant(value, ddl: str) -> Column:
    """A constant table as one foldable expression.

    Building tables literal by literal makes plans of tens of thousands of
    nodes; a JSON constant is folded to a single literal by the optimizer.
    """
    return F.from_json(F.lit(json.dumps(value)), ddl)


def str_array(values: Iterable[str]) -> Column:
    return _constant(list(values), "array<string>")


def constant_rows(ddl: str, rows: Iterable[Sequence]) -> Column:
    """Constant array of structs; scanned in order, so the first hit wins."""
    names = [f.split()[0] for f in ddl.split(", ")]
    fields = ",".join(":".join(f.split()) for f in ddl.split(", "))
    return _constant([dict(zip(names, r)) for r in rows], f"array<struct<{fields}>>")


def first_hit(rows: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(rows, test), F.lit(1))


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Fixed-size constant map probed inside the projection: no join at all."""
    return F.try_element_at(_constant(dict(mapping), "map<string,string>"), key)


def constant_lists(mapping: Mapping[str, list[str]]) -> Column:
    return _constant(dict(mapping), "map<string,array<string>>")


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    return F.exists(str_array(needles), lambda n: F.contains(c, n))


def ladder(pairs: Iterable[tuple[Column, str | Column]], otherwise) -> Column:
    """First condition that holds decides."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    otherwise = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(otherwise)
