"""Status vocabularies.  There is no single notion of "abnormal": every rule
keeps its own named predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions.basic import blank_to_null, first_upper, ladder, strip
from labtrail.functions.names import standard_status, title_fallback

# fixed values: words of a status, in order of precedence
_LADDER = [
    ("critical", "Critical"),
    ("insufficient", "Insufficient"),
    ("borderline", "Borderline"),
    ("positive", "Positive"),
    ("negative", "Negative"),
    ("flag", "Flagged"),
    ("high", "High"),
    ("low", "Low"),
    ("normal", "Normal"),
    ("within", "Normal"),
]


def _by_substring(key: Column, otherwise: Column) -> Column:
    return ladder([(F.contains(key, F.lit(s)), v) for s, v in _LADDER], otherwise)


def normalize_status(c: Column) -> Column:
    key = strip(F.lower(c))
    missing = key.isNull() | key.isin("", "n/a", "na", "not applicable")
    return F.when(missing, F.lit("N/A")).otherwise(_by_substring(key, title_fallback(c)))


def client_status(c: Column) -> Column:
    """Same ladder; an unknown status keeps its words with one capital."""
    key = strip(F.lower(c))
    missing = key.isNull() | key.isin("", "n/a", "na")
    return F.when(missing, F.lit("N/A")).otherwise(_by_substring(key, first_upper(key)))


def canonical_status(c: Column) -> Column:
    """Status at intake: exact words, then parts of words, then patterns."""
    text = F.coalesce(blank_to_null(c), F.lit("N/A"))
    low = F.lower(text)
    has = lambda s: F.contains(low, F.lit(s))
    mapped = standard_status(text)
    return ladder(
        [
            (low.isin("positive", "detected", "reactive", "present", "pos"), "Positive"),
            (low.isin("negative", "not detected", "non reactive", "absent", "neg"), "Negative"),
            (has("critical") | has("panic"), "Critical"),
            (has("high") | low.isin("h", "elevated", "above range", "borderline high"), "High"),
            (has("low") | low.isin("l", "decreased", "below range"), "Low"),
            (has("normal") | has("within range") | has("within normal"), "Normal"),
            (low.isin("na", "n/a", "not applicable", "none", "unknown"), "N/A"),
            (mapped.isin(fv.INGEST_STATUSES), mapped),
        ],
        "N/A",
    )


def status_weight(c: Column, null_weight: int) -> Column:
    """Health-score weight; matching ignores case and outer blanks."""
    key = F.lower(strip(c))
    known = ladder(
        [(key == k.lower(), F.lit(w)) for k, w in fv.STATUS_WEIGHTS.items()],
        F.lit(fv.OTHER_STATUS_WEIGHT),
    )
    return F.when(c.isNull(), F.lit(null_weight)).otherwise(known)


# --- abnormal / good predicates (never null) --------------------------------
def _isin(c: Column, *members: str) -> Column:
    return F.coalesce(c.isin(*members), F.lit(False))


def abnormal_score(c: Column) -> Column:
    return _isin(c, "High", "Low", "Critical", "Positive")


def abnormal_chat(c: Column) -> Column:
    return ~_isin(F.lower(F.coalesce(c, F.lit(""))), "normal", "negative", "n/a", "na", "")


def abnormal_dash(c: Column) -> Column:
    return _isin(F.lower(c), "high", "low", "critical", "positive", "flagged")


def abnormal_tree(c: Column) -> Column:
    return _isin(F.lower(c), "high", "low", "critical", "positive", "flagged", "insufficient")


def abnormal_panel(c: Column) -> Column:
    return severity3(c) != "NORMAL"


def abnormal_migration(c: Column) -> Column:
    return _isin(
        F.lower(c), "critical", "high", "low", "positive", "flagged", "borderline", "insufficient"
    )


def abnormal_print(c: Column) -> Column:
    return _isin(F.lower(c), "high", "low", "critical", "positive")


def good(c: Column) -> Column:
    return _isin(F.lower(c), "normal", "negative")


# --- severities -------------------------------------------------------------
def severity3(c: Column) -> Column:
    s = F.lower(client_status(c))
    return (
        F.when(s.isin("critical", "high", "positive", "flagged"), "HIGH")
        .when(s.isin("low", "insufficient", "borderline"), "BORDERLINE")
        .otherwise("NORMAL")
    )


def severity3_rank(sev: Column) -> Column:
    return F.when(sev == "HIGH", 3).when(sev == "BORDERLINE", 2).otherwise(1)


def tree_rank(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(s == "critical", 0)
        .when(s.isin("high", "positive", "flagged"), 1)
        .when(s.isin("low", "insufficient"), 2)
        .when(s.isin("normal", "negative"), 3)
        .otherwise(4)
    )


def chat_severity(c: Column) -> Column:
    """Normal wording is looked for first, whatever else the text says."""
    raw = F.lower(blank_to_null(c))
    has = lambda s: F.contains(raw, F.lit(s))
    return F.when(raw.isNull(), F.lit("UNKNOWN")).otherwise(
        ladder(
            [
                (has("normal") | has("negative") | has("within"), "NORMAL"),
                (has("high"), "HIGH"),
                (has("low"), "LOW"),
                (has("critical"), "CRITICAL"),
                (has("borderline"), "BORDERLINE"),
                (has("positive"), "POSITIVE"),
            ],
            "ABNORMAL",
        )
    )


def metric_status(metric: Column, value: Column) -> Column:
    out = None
    for name, (ok, warn, kind) in fv.METRIC_THRESHOLDS.items():
        passes = (lambda t: value >= t) if kind == "min" else (lambda t: value <= t)
        grade = F.when(passes(ok), "ok").when(passes(warn), "warn").otherwise("fail")
        out = F.when(metric == name, grade) if out is None else out.when(metric == name, grade)
    return out.otherwise("warn")
