"""Numbers, dates, reference ranges, arrays, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtrail.functions.basic import blank_to_null, let, strip

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


# --- numbers ----------------------------------------------------------------
def _to_double(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_PLAIN_NUMBER)), text.try_cast("double")).when(
        F.rlike(text, F.lit(_INFINITE)),
        F.when(F.startswith(text, F.lit("-")), F.lit(float("-inf"))).otherwise(
            F.lit(float("inf"))
        ),
    )


def parse_numeric(c: Column) -> Column:
    """Whole text is a number once thousands commas are dropped."""
    return _to_double(strip(F.translate(c, ",", "")))


def strict_numeric(c: Column) -> Column:
    """Whole text is a number; commas are not accepted."""
    return _to_double(strip(c))


def leading_numeric(c: Column) -> Column:
    """Numeric prefix of the text (commas dropped), e.g. ``5.2 mg`` -> 5.2."""
    prefix = F.regexp_extract(
        strip(F.translate(c, ",", "")), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0
    )
    return F.nullif(prefix, F.lit("")).try_cast("double")


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


# --- dates ------------------------------------------------------------------
def _date(c: Column, shape: str, fmt: str) -> Column:
    """Strict parse, tried only when the text has the right shape."""
    return F.when(F.rlike(c, F.lit(shape)), F.try_to_date(c, fmt))


def _date_with_pivot_year(c: Column, shape: str, fmt: str) -> Column:
    """Two-digit years 69-99 belong to the 1900s."""
    d = _date(c, shape, fmt)
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


D, M = r"\d{1,2}", r"\d{1,2}"
_TIME = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)"
)
_DAY_MONTH = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[ \-]{_MONTH}[ ,\-]+(\d{{4}})$"
_MONTH_DAY = rf"(?i)^{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$"


def _without_time(t: Column) -> Column:
    return F.regexp_replace(t, r"^(\d[\d/.\-]*\d)" + _TIME, "$1")


def _spelled_date(t: Column) -> Column:
    """A date with its month as a word, in full or by three letters."""
    def read(pattern: str, day: int, month: int) -> Column:
        part = lambda g: F.regexp_extract(t, pattern, g)
        text = F.concat_ws(" ", part(day), F.initcap(F.substring(part(month), 1, 3)), part(3))
        return F.when(F.rlike(t, F.lit(pattern)), F.try_to_date(text, "d MMM yyyy"))

    return F.coalesce(read(_DAY_MONTH, 1, 2), read(_MONTH_DAY, 2, 1))


_WEEKDAY = r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?[.,]?\s+"
_BETWEEN = r"[ ,./\-]+"
_ANY_MONTH = _MONTH.replace("sep(?:tember)?", "sept?(?:ember)?")
_ANY_DAY, _ANY_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})"


def _worded_date(t: Column) -> Column:
    """A date with its month as a word, in any order and with any separators; without a day it is the first."""
    def read(pattern: str, day: int | None, month: int, year: int) -> Column:
        part = lambda g: F.regexp_extract(t, pattern, g)
        short = F.length(part(year)) == 2
        whole = F.when(short, F.concat(F.when(part(year) >= "69", F.lit("19")).otherwise(F.lit("20")), part(year))).otherwise(part(year))
        text = F.concat_ws(" ", part(day) if day else F.lit("1"), F.initcap(F.substring(part(month), 1, 3)), whole)
        return F.when(F.rlike(t, F.lit(pattern)), F.try_to_date(text, "d MMM yyyy"))

    b = _BETWEEN
    return F.coalesce(
        read(rf"(?i)^{_ANY_DAY}{b}{_ANY_MONTH}{b}{_ANY_YEAR}$", 1, 2, 3), read(rf"(?i)^{_ANY_MONTH}{b}{_ANY_DAY}{b}{_ANY_YEAR}$", 2, 1, 3),
        read(rf"(?i)^(\d{{4}}){b}{_ANY_MONTH}{b}{_ANY_DAY}$", 3, 2, 1), read(rf"(?i)^{_ANY_MONTH}{b}(\d{{4}})$", None, 1, 2),
    )


def _loose_dates(t: Column) -> list[Column]:
    """Day first with dots and a short year, month first, a month alone, and months as words."""
    seps = (("/", "/"), ("-", "-"), (r"\.", "."))
    months = ((r"^\d{4}-\d{1,2}$", "yyyy-M"), (r"^\d{4}/\d{1,2}$", "yyyy/M"), (r"^\d{1,2}-\d{4}$", "M-yyyy"), (r"^\d{1,2}/\d{4}$", "M/yyyy"))
    return [
        _date_with_pivot_year(t, rf"^{D}\.{M}\.\d{{2}}$", "d.M.yy"),
        *[_date(t, rf"^{D}{sep}{M}{sep}\d{{4}}$", f"M{plain}d{plain}yyyy") for sep, plain in seps],
        *[_date_with_pivot_year(t, rf"^{D}{sep}{M}{sep}\d{{2}}$", f"M{plain}d{plain}yy") for sep, plain in seps],
        *[_date(t, shape, fmt) for shape, fmt in months],
        _worded_date(t),
    ]


def parse_date_day_first(c: Column, iso_strict: bool = False) -> Column:
    """Day-first date.  Unless ``iso_strict``, ``2024-05-03`` reads as 5 March:
    a year-first text is tried as year-day-month before year-month-day.  A text
    that can't be day-first is read month-first, a month alone is its first day.
    A weekday before the date and a time behind it are left out."""
    t = _without_time(F.regexp_replace(blank_to_null(c), _WEEKDAY, ""))
    year_first = [
        (rf"^\d{{4}}{sep}\d{{1,2}}{sep}\d{{1,2}}$", fmt.replace("-", plain))
        for sep, plain in (("-", "-"), ("/", "/"), (r"\.", ".")) for fmt in ("yyyy-d-M", "yyyy-M-d") if not iso_strict or fmt == "yyyy-M-d"
    ]
    tries = [
        _date(t, rf"^{D}/{M}/\d{{4}}$", "d/M/yyyy"),
        _date(t, rf"^{D}-{M}-\d{{4}}$", "d-M-yyyy"),
        _date(t, rf"^{D}\.{M}\.\d{{4}}$", "d.M.yyyy"),
        *[_date(t, shape, fmt) for shape, fmt in year_first],
        _date_with_pivot_year(t, rf"^{D}/{M}/\d{{2}}$", "d/M/yy"),
        _date_with_pivot_year(t, rf"^{D}-{M}-\d{{2}}$", "d-M-yy"),
        _date(t, r"^\d{8}$", "yyyyMMdd"),
        # seldom needed: kept out of the code generated for every row
        let(t, lambda x: F.coalesce(*_loose_dates(x))),
    ]
    return F.when(t != "N/A", F.coalesce(*tries))


def parse_sort_date(c: Column) -> Column:
    """Date used for ordering; null means unknown and sorts last."""
    t = blank_to_null(c)
    return F.when(
        F.lower(t) != "n/a",
        F.coalesce(
            _date(t, rf"^{D}-{M}-\d{{4}}$", "d-M-yyyy"),
            _date(t, rf"^{D}/{M}/\d{{4}}$", "d/M/yyyy"),
            _date(t, rf"^\d{{4}}-{M}-{D}$", "yyyy-M-d"),
            _date(t, rf"^\d{{4}}/{M}/{D}$", "yyyy/M/d"),
            _date_with_pivot_year(t, rf"^{D}-{M}-\d{{2}}$", "d-M-yy"),
            _date_with_pivot_year(t, rf"^{D}/{M}/\d{{2}}$", "d/M/yy"),
            _date(_without_time(t), r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
        ),
    )


def parse_report_date(c: Column) -> Column:
    """ISO first, then day-month-year; two-digit years are 20yy."""
    t = blank_to_null(c)
    return F.coalesce(
        _date(t, r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
        _date(t, r"^\d+-\d+-\d{4}$", "d-M-yyyy"),
        _date(t, r"^\d+-\d+-\d{2}$", "d-M-yy"),
        _date(t, r"^\d+/\d+/\d{4}$", "d/M/yyyy"),
        _date(t, r"^\d+/\d+/\d{2}$", "d/M/yy"),
    )


def parse_client_date(c: Column) -> Column:
    """Client date: d-m-y (2-digit years are 20yy), ISO with or without a time,
    year first with slashes, or a month's name; null when unknown."""
    t = blank_to_null(c)
    return F.coalesce(
        _date(t, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        _date(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        _date(t, r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
        _date(t, r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
        _date(_without_time(t), r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
        _date(_without_time(t), r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        _spelled_date(t),
    )


def format_day_first(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "dd-MM-yyyy"), F.lit("N/A"))


# --- reference ranges -------------------------------------------------------
_NUM = r"([\d.]+)"


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("double")


def reference_range(c: Column) -> Column:
    """struct(low, high, kind) of a printed range; all null when unreadable."""
    t = blank_to_null(c)
    return let(F.when(F.lower(t) != "n/a", t), _read_range)


def _read_range(t: Column) -> Column:
    span = rf"{_NUM}\s*-\s*{_NUM}"
    below = rf"(?i)(?:<|Less than|upto)\s*{_NUM}"
    above = rf"(?i)(?:>|Greater than|above)\s*{_NUM}"
    low1, high1 = _group(t, span, 1), _group(t, span, 2)
    low2, high2 = _group(t, above, 1), _group(t, below, 1)
    kind = (
        F.when(low1.isNotNull() & high1.isNotNull(), "range")
        .when(high2.isNotNull(), "less_than")
        .when(low2.isNotNull(), "greater_than")
        .when(F.lower(t).isin("negative", "non reactive", "not detected"), "qualitative_normal")
        .when(F.lower(t).isin("positive", "reactive", "detected"), "qualitative_abnormal")
    )
    return F.struct(
        F.when(kind == "range", low1).when(kind == "greater_than", low2).alias("low"),
        F.when(kind == "range", high1).when(kind == "less_than", high2).alias("high"),
        kind.alias("kind"),
    )


def client_range(c: Column) -> Column:
    """struct(low, high) as the client reads it: symbols only, no words."""
    span = r"([0-9.]+)\s*[-–]\s*([0-9.]+)"
    lt, gt = r"[<≤]\s*([0-9.]+)", r"[>≥]\s*([0-9.]+)"
    is_span = F.coalesce(F.rlike(c, F.lit(span)), F.lit(False))
    is_lt = ~is_span & F.coalesce(F.rlike(c, F.lit(lt)), F.lit(False))
    is_gt = ~is_span & ~is_lt & F.coalesce(F.rlike(c, F.lit(gt)), F.lit(False))
    return F.struct(
        F.when(is_span, _group(c, span, 1)).when(is_gt, _group(c, gt, 1)).alias("low"),
        F.when(is_span, _group(c, span, 2)).when(is_lt, _group(c, lt, 1)).alias("high"),
    )


def deviation_percent(value: Column, low: Column, high: Column, severity: Column) -> Column:
    default = F.when(severity == "HIGH", 20).when(severity == "BORDERLINE", 8).otherwise(0)
    under = js_round((low - value) / F.nullif(F.abs(low), F.lit(0.0)) * 100)
    over = js_round((value - high) / F.nullif(F.abs(high), F.lit(0.0)) * 100)
    both = low.isNotNull() & high.isNotNull()
    is_under = (value < low) & (low != 0)
    is_over = (value > high) & (high != 0)
    return (
        F.when(value.isNull(), default)
        .when(both & is_under, under)
        .when(both & is_over, over)
        .when(both, 0)
        .when(is_over, over)
        .when(is_under, under)
        .otherwise(default)
        .cast("bigint")
    )


def trend_threshold(low: Column, high: Column, baseline: Column) -> Column:
    return (
        F.when(F.abs(high - low) > 0, F.abs(high - low) * 0.05)
        .when(high.isNotNull() & (high != 0), F.abs(high) * 0.05)
        .when(low.isNotNull() & (low != 0), F.abs(low) * 0.05)
        .otherwise(F.greatest(F.abs(baseline) * 0.05, F.lit(0.5)))
    )


# --- arrays, signatures -----------------------------------------------------
def unique_strings(arr: Column) -> Column:
    """Trimmed, non-blank, first-seen order."""
    trimmed = F.transform(arr, lambda x: strip(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def coerce_aliases(json_text: Column) -> Column:
    """JSON list, JSON string or plain text to an alias array."""
    t = blank_to_null(json_text)
    as_list = F.from_json(t, "array<string>")
    as_string = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]
    return (
        F.when(t.isNull(), F.array().cast("array<string>"))
        .when(F.startswith(t, F.lit("[")) & as_list.isNotNull(), unique_strings(as_list))
        .when(F.startswith(t, F.lit('"')), unique_strings(F.array(as_string)))
        .when(F.rlike(t, F.lit(r"^(\{|-?\d|true$|false$|null$)")), F.array().cast("array<string>"))
        .otherwise(F.array(t))
    )


def signature(*cols: str) -> Column:
    """Stable whole-row signature: sorted keys, nulls kept."""
    row = F.struct(*[F.col(c) for c in sorted(cols)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def completeness(result: Column, ref_range: Column, unit: Column, status: Column) -> Column:
    st = F.lower(blank_to_null(status))
    return (
        F.when(parse_numeric(result).isNotNull(), 2).otherwise(0)
        + F.when(blank_to_null(ref_range).isNotNull(), 2).otherwise(0)
        + F.when(blank_to_null(unit).isNotNull(), 1).otherwise(0)
        + F.when(st.isNotNull() & (st != "n/a"), 1).otherwise(0)
    )


def recency_score(last_updated: Column, as_of: Column) -> Column:
    """3/2/1/0 for guidance up to 12/24/36 thirty-day months old."""
    t = strip(last_updated)
    shape = r"^(\d{4})(-\d{2})?$"
    month = F.nullif(F.regexp_extract(t, r"^\d{4}-(\d{2})$", 1), F.lit(""))
    first = F.when(
        F.rlike(t, F.lit(shape)),
        F.make_date(
            F.substring(t, 1, 4).cast("int"),
            F.greatest(F.coalesce(month.cast("int"), F.lit(1)), F.lit(1)),
            F.lit(1),
        ),
    )
    months = F.datediff(as_of, first) / 30.0
    return F.when(months <= 12, 3).when(months <= 24, 2).when(months <= 36, 1).otherwise(0)
