"""Person names, file names, lab names, chat text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions.json_scan import first_balanced
from labtrail.functions.basic import (
    blank_to_null,
    constant_lists,
    contains_any,
    ladder,
    squeeze,
    strip,
    str_array,
    sub,
    title_case,
    words,
)


# --- people -----------------------------------------------------------------
def normalize_person(c: Column) -> Column:
    n = F.lower(strip(c))
    for title in fv.NAME_TITLE_PATTERNS:
        n = sub(n, rf"\b{title}\b\.?\s*", "")
    titled = F.array_join(F.transform(words(n), title_case), " ")
    return F.when(c.isNull() | (c == "N/A"), F.lit("")).otherwise(titled)


def persons_match(a: Column, b: Column) -> Column:
    """Same person?  Arguments are already normalized names."""
    x, y = F.split(a, " "), F.split(b, " ")
    shared = F.size(F.array_intersect(x, y))
    total = F.size(F.array_union(x, y))
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (a == "") | (b == "") | subset | ((shared >= 2) & (shared / total >= 0.6))


def self_profile_name(display_name: Column, email: Column) -> Column:
    local = strip(sub(F.split(email, "@")[0], r"\.", " "))
    from_mail = F.when(F.contains(email, F.lit("@")), F.nullif(title_case(local), F.lit("")))
    return F.coalesce(blank_to_null(display_name), from_mail, F.lit("My Profile"))


# --- files and labs ---------------------------------------------------------
def file_key(c: Column) -> Column:
    """Base name, trimmed, lower case; empty when missing."""
    base = F.element_at(F.split(sub(c, r"\\", "/"), "/"), -1)
    return F.coalesce(F.lower(strip(base)), F.lit(""))


def file_stem(key: Column) -> Column:
    return sub(key, r"(?<=.)\.[^.]+$", "")


def patient_from_export_name(c: Column) -> Column:
    found = F.nullif(
        F.regexp_extract(F.lower(c), r"medical_reports?_.*?_([^_]+(?:_[^_]+)*)", 1), F.lit("")
    )
    return F.coalesce(title_case(F.translate(found, "_", " ")), F.lit("N/A"))


def clean_lab(c: Column) -> Column:
    """Longest non-billing part of a lab name; the first listed separator that
    occurs is the one that splits."""
    lab = strip(c)
    parts = ladder(
        [
            (F.contains(lab, F.lit(s)), F.split(lab, "[" + ("\\" + s) + "]"))
            for s in fv.LAB_SEPARATORS
        ],
        F.array(lab),
    )
    kept = F.filter(
        parts,
        lambda p: ~contains_any(F.lower(p), fv.BILLING_TERMS)
        & (F.length(strip(p)) > 2)
        & ~F.rlike(strip(p), F.lit(r"^\d+$")),
    )
    ranked = F.transform(
        kept, lambda p, i: F.struct(F.length(strip(p)).alias("n"), (-i).alias("at"), strip(p).alias("p"))
    )
    return F.when(c.isNull() | (c == "N/A"), F.lit("Unknown Lab")).otherwise(
        F.coalesce(F.array_max(ranked)["p"], lab)
    )


# --- failures ---------------------------------------------------------------
def is_rate_limit_error(c: Column) -> Column:
    return contains_any(F.lower(F.coalesce(c, F.lit(""))), ["429", "quota exceeded", "rate limit"])


def is_rate_limit_reason(c: Column) -> Column:
    return contains_any(
        F.lower(F.coalesce(c, F.lit(""))), ["rate limit", "quota", " 429", ":429"]
    )


def retry_delay(c: Column) -> Column:
    """``retry in 90s`` / ``retry in 500ms`` to a short label."""
    in_seconds = F.nullif(F.regexp_extract(c, r"(?i)retry in\s+([\d\.]+)s", 1), F.lit(""))
    in_millis = F.nullif(F.regexp_extract(c, r"(?i)retry in\s+([\d\.]+)ms", 1), F.lit(""))
    secs = F.coalesce(in_seconds.try_cast("double"), in_millis.try_cast("double") / 1000.0)

    def label(divisor: int, unit: str) -> Column:
        return F.concat(F.bround(secs / divisor).cast("bigint").cast("string"), F.lit(unit))

    readable = (
        F.when(secs < 1, F.lit("<1s"))
        .when(secs < 120, label(1, "s"))
        .when(secs < 7200, label(60, "m"))
        .when(secs < 172800, label(3600, "h"))
        .otherwise(label(86400, "d"))
    )
    return (
        F.when(secs.isNotNull(), readable)
        .when(in_seconds.isNotNull(), F.concat(in_seconds, F.lit("s")))
        .when(in_millis.isNotNull(), F.concat(in_millis, F.lit("ms")))
    )


# --- chat text --------------------------------------------------------------
def query_text(c: Column) -> Column:
    return strip(squeeze(sub(F.lower(c), r"[^a-z0-9%+\-\s]", " ")))


def query_tokens(c: Column) -> Column:
    stop = str_array(fv.STOP_WORDS)
    return F.filter(
        F.split(query_text(c), " "),
        lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t),
    )


def expanded_tokens(tokens: Column) -> Column:
    """Distinct tokens followed by the concepts they stand for."""
    table = constant_lists(fv.CONCEPT_EXPANSIONS)
    extra = F.flatten(
        F.transform(
            tokens,
            lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")),
        )
    )
    return F.array_distinct(F.concat(tokens, extra))


CHUNK_CHARS = 140


def answer_chunks(c: Column) -> Column:
    """Sentences packed into chunks of at most 140 characters."""
    text = strip(squeeze(c))
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    one = F.lit(1)

    def pieces(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / CHUNK_CHARS).cast("int"))
        return F.transform(
            starts, lambda i: F.substring(s, i * CHUNK_CHARS + one, F.lit(CHUNK_CHARS))
        )

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fits = F.length(joined) <= CHUNK_CHARS
        flushed = F.when(acc["open"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )
        short = F.length(s) <= CHUNK_CHARS
        return F.struct(
            F.when(fits, acc["done"])
            .when(short, flushed)
            .otherwise(F.concat(flushed, pieces(s)))
            .alias("done"),
            F.when(fits, joined).when(short, s).otherwise(F.lit("")).alias("open"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(
        sentences,
        start,
        step,
        lambda a: F.when(a["open"] == "", a["done"]).otherwise(
            F.concat(a["done"], F.array(a["open"]))
        ),
    )


_SOURCES = r"(?im)^(?:\*\*)?Sources:(?:\*\*)?"


def split_sources(c: Column) -> Column:
    """struct(body, sources): the answer cut at its ``Sources:`` line."""
    text = F.coalesce(strip(sub(c, r"\r\n", "\n")), F.lit(""))
    cut = F.regexp_instr(text, F.lit(_SOURCES))
    return F.struct(
        F.when(cut > 0, strip(F.substring(text, F.lit(1), cut - 1))).otherwise(text).alias("body"),
        F.when(cut > 0, strip(F.substring(text, cut, F.length(text)))).alias("sources"),
    )


def relative_age(d: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, d)
    months = F.floor(days / 30)
    return (
        F.when(d.isNull(), "Unknown")
        .when(days <= 0, "Today")
        .when(days == 1, "1 day ago")
        .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(months == 1, "1 month ago")
        .otherwise(F.concat(months.cast("string"), F.lit(" months ago")))
    )


def range_label(start: Column, end: Column) -> Column:
    a, b = F.date_format(start, "MMM yyyy"), F.date_format(end, "MMM yyyy")
    return (
        F.when(start.isNull() & end.isNull(), F.lit("No reports yet"))
        .when(start.isNotNull() & end.isNotNull(), F.concat(a, F.lit(" - "), b))
        .otherwise(F.coalesce(a, b))
    )


# --- payload text -----------------------------------------------------------
def first_json_object(c: Column) -> Column:
    """Fenced JSON block when there is one, else the first balanced object."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    start = F.instr(c, "{")
    tail = F.when(start > 0, F.substring(c, start, F.length(c)))
    return F.coalesce(fenced, first_balanced(tail))
