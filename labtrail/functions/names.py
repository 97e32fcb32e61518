"""Test-name and category keys, canonical names, canonical categories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions.basic import (
    blank_to_null,
    capitalize,
    constant_rows,
    first_hit,
    ladder,
    let,
    lookup,
    squeeze,
    strip,
    str_array,
    sub,
    title_case,
    words,
)

MISSING_WORDS = ["n/a", "na", "none"]
UNKNOWN_TEST = "Unknown Test"


# --- keys -------------------------------------------------------------------
def lookup_key(c: Column) -> Column:
    k = strip(F.lower(c))
    k = sub(k, r"[()\[\]]", " ")
    k = sub(k, r"\\+", " ")
    k = sub(k, r"_+", " ")
    k = sub(k, r"\s*/\s*", " / ")
    k = sub(k, r"[^a-z0-9\-&/+,.\s]", " ")
    return F.trim(squeeze(k), F.lit(" -"))


def compact(c: Column) -> Column:
    return sub(F.lower(c), r"[\s\-/,.]+", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s\-/,.]+"), lambda t: t != "")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(tokens(c), lambda t: F.substring(t, 1, 1)), "")


_QUALIFIER = (
    r"\s*\(\s*(urine|serum|plasma|blood|routine|total|electrical\s+impedance"
    r"|rbc\s+histogram|appearance)\s*\)"
)
_ABBREVIATION = r"\(\s*[a-z]{2,6}\s*\)"


def _drop_explained_abbreviations(source: Column) -> Column:
    """Remove ``(abbr)`` when the text before it explains the abbreviation.

    The text is cut at every bracketed abbreviation; one left-to-right fold
    carries the untouched prefix and the text kept so far.
    """
    return F.when(
        F.rlike(source, F.lit(_ABBREVIATION)), let(source, _fold_abbreviations)
    ).otherwise(source)


def _fold_abbreviations(source: Column) -> Column:
    gaps = F.split(source, _ABBREVIATION, -1)
    marks = F.regexp_extract_all(source, F.lit(_ABBREVIATION), F.lit(0))
    pieces = F.arrays_zip(gaps.alias("gap"), marks.alias("mark"))

    def step(acc: Column, piece: Column) -> Column:
        prefix = F.concat(acc["prefix"], piece["gap"])
        mark = F.coalesce(piece["mark"], F.lit(""))
        abbr = sub(mark, r"[()\s]", "")
        base = words(prefix)
        first_letters = F.array_join(F.transform(base, lambda w: F.substring(w, 1, 1)), "")
        explained = (abbr != "") & (
            F.contains(first_letters, abbr) | F.contains(F.array_join(base, ""), abbr)
        )
        return F.struct(
            F.concat(prefix, mark).alias("prefix"),
            F.concat(acc["kept"], piece["gap"], F.when(explained, "").otherwise(mark)).alias("kept"),
        )

    start = F.struct(F.lit("").alias("prefix"), F.lit("").alias("kept"))
    return F.aggregate(pieces, start, step, lambda acc: acc["kept"])


def structural_clean(c: Column) -> Column:
    k = let(sub(strip(F.lower(c)), _QUALIFIER, ""), _drop_explained_abbreviations)
    k = sub(k, r"[()]", " ")
    k = sub(k, r"\s*/\s*", "/")
    k = sub(k, r"\s*-\s*", "-")
    k = sub(k, r"[^a-z0-9%\-/,.\s]", " ")
    return F.coalesce(blank_to_null(squeeze(k)), F.lit("unknown test"))


def blocklist_key(c: Column) -> Column:
    return strip(squeeze(sub(structural_clean(c), r"[\-/,.]+", " ")))


# --- display forms ----------------------------------------------------------
def title_fallback(c: Column) -> Column:
    def word(w: Column) -> Column:
        return F.when(F.length(w) > 4, capitalize(w)).otherwise(F.upper(w))

    return F.array_join(F.transform(words(strip(c)), word), " ")


def display_name(c: Column) -> Column:
    def word(w: Column) -> Column:
        k = F.lower(w)
        short = (F.length(k) <= 3) & F.rlike(k, F.lit(r"^\p{L}+$"))
        return F.coalesce(
            lookup(fv.DISPLAY_TOKENS, k), F.when(short, F.upper(k)).otherwise(capitalize(k))
        )

    return F.array_join(F.transform(words(strip(c)), word), " ")


# --- alias tables (constants derived once on the driver) --------------------
def _key_of(alias: str) -> str:
    k = re.sub(r"[()\[\]_]|\\+", " ", alias.lower().strip())
    k = re.sub(r"\s*/\s*", " / ", k)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\-&/+,.\s]", " ", k)).strip(" -")


def _compact_of(text: str) -> str:
    return re.sub(r"[\s\-/,.]+", "", text.lower())


def _first_wins(pairs) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


BY_ALIAS = dict(fv.TEST_NAME_MAP)
BY_LOOKUP_KEY = {_key_of(a): c for a, c in fv.TEST_NAME_MAP if _key_of(a)}
BY_COMPACT_ALIAS = _first_wins((_compact_of(a), c) for a, c in fv.TEST_NAME_MAP)
BY_COMPACT_KEY = _first_wins((_compact_of(k), c) for k, c in BY_LOOKUP_KEY.items())
CATEGORY_BY_KEY = dict(fv.CATEGORY_MAP)


def is_missing(c: Column) -> Column:
    t = strip(F.lower(c))
    return t.isNull() | (t == "") | t.isin(MISSING_WORDS)


def canonical_from_lookup(c: Column) -> Column:
    """Canonical name when the alias table knows the text, else null."""
    return let(
        lookup_key(c),
        lambda key: F.coalesce(lookup(BY_LOOKUP_KEY, key), lookup(BY_COMPACT_KEY, compact(key))),
    )


def known_test_name(key: Column) -> Column:
    """Alias-table probe of a cleaned key, in order of precedence."""
    squeezed = compact(key)
    return F.coalesce(
        lookup(BY_ALIAS, key),
        lookup(BY_LOOKUP_KEY, lookup_key(key)),
        lookup(BY_COMPACT_ALIAS, squeezed),
        lookup(BY_COMPACT_KEY, squeezed),
    )


def normalize_test_name(c: Column) -> Column:
    return F.when(is_missing(c), F.lit(UNKNOWN_TEST)).otherwise(
        let(structural_clean(c), lambda key: F.coalesce(known_test_name(key), display_name(key)))
    )


def cluster_key(test_name: Column) -> Column:
    """Equivalence class of a test name when only the alias table may merge.

    Two names are the same test when their cleaned keys are equal or both are
    known under one canonical name, so a class id replaces a pairwise test.
    """
    return let(
        structural_clean(test_name),
        lambda key: F.coalesce(
            F.concat(F.lit("c:"), canonical_from_lookup(key)), F.concat(F.lit("k:"), key)
        ),
    )


def category_by_containment(key: Column) -> Column:
    entries = constant_rows("k string, v string", fv.CATEGORY_MAP)
    return first_hit(entries, lambda e: F.contains(e["k"], key) | F.contains(key, e["k"]))["v"]


def canonical_category(c: Column) -> Column:
    return F.when(is_missing(c), F.lit("Other")).otherwise(
        let(
            lookup_key(c),
            lambda key: F.coalesce(
                lookup(CATEGORY_BY_KEY, key), category_by_containment(key), F.lit("Other")
            ),
        )
    )


def category_hint(test_name: Column) -> Column:
    """Category hinted by the test name itself, null when no hint applies."""
    bound = F.struct(
        structural_clean(test_name).alias("key"),
        canonical_from_lookup(structural_clean(test_name)).alias("known"),
    )
    found = let(bound, lambda b: _first_hint(b["key"], b["known"]))
    return F.when(blank_to_null(test_name).isNotNull(), found)


def _known(alias: str) -> str | None:
    key = _key_of(alias)
    return BY_LOOKUP_KEY.get(key) or BY_COMPACT_KEY.get(_compact_of(key))


def _first_hint(key: Column, known: Column) -> Column:
    entries = constant_rows(
        "h string, canonical string, cat string", [(h, _known(h), cat) for h, cat in fv.TEST_CATEGORY_HINTS]
    )
    return first_hit(
        entries,
        lambda e: F.contains(key, e["h"])
        | F.contains(e["h"], key)
        | F.coalesce(e["canonical"] == known, F.lit(False)),
    )["cat"]


def name_score(c: Column) -> Column:
    """How good a raw spelling is as the display name of its cluster."""
    parts = words(c)
    letters = sub(c, "[^A-Za-z]", "")
    wordy = F.exists(parts, lambda w: F.length(w) > 4)
    abbreviation = (F.size(parts) > 0) & F.forall(
        parts, lambda w: F.length(sub(w, "[^A-Za-z]", "")) <= 4
    )
    return (
        F.length(c)
        + F.when(F.rlike(c, F.lit(r"\(.*\)")) & wordy, 20).otherwise(0)
        - F.when((letters != "") & (letters == F.upper(letters)), 15).otherwise(0)
        - F.when(abbreviation, 20).otherwise(0)
    )


# --- ordered pattern maps ---------------------------------------------------
def standardize(c: Column, patterns, case: str = "title") -> Column:
    """First pattern found anywhere in the text decides the standard form."""
    text = strip(c)
    recase = {"title": str.title, "lower": str.lower}.get(case, str)
    kept = {"title": title_case, "lower": F.lower}.get(case, lambda x: x)(text)
    if not patterns:
        return kept
    # literal patterns are compiled once; one read from an array would be for every row
    known = let(text, lambda t: ladder([(F.rlike(t, F.lit(f"(?iu){p}")), recase(v)) for p, v in patterns], F.lit(None).cast("string")))
    return F.coalesce(known, kept)


def standard_test_name(c: Column) -> Column:
    return standardize(c, fv.TEST_NAME_PATTERNS, "title")


def standard_unit(c: Column) -> Column:
    return standardize(c, fv.UNIT_PATTERNS, "original")


def standard_status(c: Column) -> Column:
    return standardize(c, fv.STATUS_PATTERNS, "title")


# --- names used for looser grouping ----------------------------------------
def grouping_name(c: Column) -> Column:
    n = sub(F.lower(strip(c)), r"\([^)]*\)", "")
    n = sub(n, r"\s*-\s*", "-")
    for word in fv.TRAILING_WORDS:
        n = sub(n, rf"[\s-]*\b{word}\b$", "")
    n = sub(n, r"[^a-z0-9\s-]", "")
    n = F.trim(squeeze(n), F.lit(" -"))
    return F.coalesce(sub(n, r"(?<=.)(?<!s)s$", ""), F.lit("N/A"))


def chat_key(c: Column) -> Column:
    return strip(squeeze(sub(F.lower(c), r"[^a-z0-9\s]", " ")))


def alnum_key(c: Column) -> Column:
    return sub(F.lower(c), "[^a-z0-9]", "")


def lower_is_better(c: Column) -> Column:
    key = alnum_key(c)
    return F.exists(str_array(fv.LOWER_IS_BETTER), lambda k: F.contains(key, k))


# --- the looser client spelling rules --------------------------------------
def client_key(c: Column) -> Column:
    k = sub(strip(F.lower(c)), r"[()]", "")
    k = sub(k, r"_+", " ")
    k = sub(k, r"\s*/\s*", " / ")
    k = sub(k, r"[^a-z0-9\-&/+\s]", " ")
    return strip(squeeze(k))


def _client_key_of(alias: str) -> str:
    k = re.sub(r"[()]", "", alias.lower().strip())
    k = re.sub(r"\s*/\s*", " / ", re.sub(r"_+", " ", k))
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\-&/+\s]", " ", k)).strip()


CLIENT_BY_KEY = {_client_key_of(a): c for a, c in fv.TEST_NAME_MAP}
CLIENT_BY_COMPACT = _first_wins((k.replace(" ", ""), c) for k, c in CLIENT_BY_KEY.items())


def client_test_name(c: Column) -> Column:
    """Client rules: exact, compact, then prefix / token-subset fuzzy match."""
    found = let(client_key(c), lambda key: _client_match(key, strip(c)))
    return F.when(blank_to_null(c).isNull(), F.lit(UNKNOWN_TEST)).otherwise(found)


def _client_match(key: Column, original: Column) -> Column:
    squeezed = sub(key, r"\s+", "")
    entries = constant_rows(
        "k string, ck string, v string", [(k, k.replace(" ", ""), v) for k, v in CLIENT_BY_KEY.items()]
    )
    own = F.filter(F.split(key, " "), lambda t: t != "")
    own_ratio = F.contains(key, F.lit("ratio"))

    def hit(e: Column) -> Column:
        theirs = F.filter(F.split(e["k"], " "), lambda t: t != "")
        long_enough = F.least(F.length(squeezed), F.length(e["ck"])) >= 8
        prefix = F.when(
            F.length(squeezed) <= F.length(e["ck"]), F.startswith(e["ck"], squeezed)
        ).otherwise(F.startswith(squeezed, e["ck"]))
        own_shorter = F.size(own) <= F.size(theirs)
        subset = F.when(
            own_shorter, (F.size(own) >= 2) & (F.size(F.array_except(own, theirs)) == 0)
        ).otherwise((F.size(theirs) >= 2) & (F.size(F.array_except(theirs, own)) == 0))
        return (own_ratio == F.contains(e["k"], F.lit("ratio"))) & long_enough & (prefix | subset)

    fuzzy = first_hit(entries, hit)["v"]
    titled = F.array_join(F.transform(words(original), capitalize), " ")
    return F.coalesce(
        lookup(BY_ALIAS, key),
        lookup(CLIENT_BY_KEY, key),
        lookup(CLIENT_BY_COMPACT, squeezed),
        fuzzy,
        titled,
    )
