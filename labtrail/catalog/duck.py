"""DuckDB SQL text for the check queries: expressions and shared views.

Written for DuckDB on its own terms; the Spark side never reads this module.
"""

from __future__ import annotations

from labtrail import fixed_values as fv
from labtrail.catalog.views import SQL, sql_list, sql_text

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rr(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(to)}, 'g')"


def let(value: str, var: str, body: str) -> str:
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def nz(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def capitalize(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w_: w_ <> '')"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
        f"lambda t_: {capitalize('t_')}), '')"
    )


def lookup_key(x: str) -> str:
    k = rr(strip(f"lower({x})"), r"[()\[\]]", " ")
    k = rr(rr(k, r"\\+", " "), "_+", " ")
    k = rr(k, r"\s*/\s*", " / ")
    k = rr(k, r"[^a-z0-9\-&/+,.\s]", " ")
    return f"trim({rr(k, chr(92) + 's+', ' ')}, ' -')"


def compact(x: str) -> str:
    return rr(f"lower({x})", r"[\s\-/,.]+", "")


ABBR = r"\(\s*[a-z]{2,6}\s*\)"
QUAL = (
    r"\s*\(\s*(urine|serum|plasma|blood|routine|total|electrical\s+impedance"
    r"|rbc\s+histogram|appearance)\s*\)"
)


def structural_clean(x: str) -> str:
    src = rr(strip(f"lower({x})"), QUAL)
    prefix = (
        "array_to_string(list_transform(range(1, i_ + 1), lambda j_: p_.segs[j_] || "
        "CASE WHEN j_ < i_ THEN p_.marks[j_] ELSE '' END), '')"
    )
    inits = f"array_to_string(list_transform({words(prefix)}, lambda v_: left(v_, 1)), '')"
    packed = rr(prefix, r"\s+")
    abbr = rr("p_.marks[i_]", r"[()\s]")
    kept = (
        f"array_to_string(list_transform(range(1, len(p_.marks) + 1), lambda i_: "
        f"CASE WHEN contains({inits}, {abbr}) OR contains({packed}, {abbr}) THEN '' ELSE p_.marks[i_] END "
        f"|| p_.segs[i_ + 1]), '')"
    )
    parts = (
        f"{{'segs': regexp_split_to_array(s_, {sql_text(ABBR)}), "
        f"'marks': regexp_extract_all(s_, {sql_text(ABBR)})}}"
    )
    cleaned = let(src, "s_", let(parts, "p_", f"p_.segs[1] || {kept}"))
    k = rr(cleaned, r"[()]", " ")
    k = rr(rr(k, r"\s*/\s*", "/"), r"\s*-\s*", "-")
    k = rr(rr(k, r"[^a-z0-9%\-/,.\s]", " "), r"\s+", " ")
    return f"coalesce({nz(k)}, 'unknown test')"


def title_fallback(x: str) -> str:
    return (
        f"array_to_string(list_transform({words(strip(x))}, lambda w1_: "
        f"CASE WHEN length(w1_) > 4 THEN {capitalize('w1_')} ELSE upper(w1_) END), ' ')"
    )


def display_name(x: str) -> str:
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in fv.DISPLAY_TOKENS.items())
    return (
        f"array_to_string(list_transform({words(strip(x))}, lambda w1_: CASE lower(w1_) {cases} ELSE "
        f"CASE WHEN length(w1_) <= 3 AND regexp_full_match(w1_, '\\p{{L}}+') THEN upper(w1_) "
        f"ELSE {capitalize('w1_')} END END), ' ')"
    )


STATUS_LADDER = [
    ("critical", "Critical"), ("insufficient", "Insufficient"), ("borderline", "Borderline"),
    ("positive", "Positive"), ("negative", "Negative"), ("flag", "Flagged"), ("high", "High"),
    ("low", "Low"), ("normal", "Normal"), ("within", "Normal"),
]


def _ladder(k: str) -> str:
    return " ".join(f"WHEN contains({k}, '{s}') THEN '{v}'" for s, v in STATUS_LADDER)


def normalize_status(x: str) -> str:
    k = strip(f"lower({x})")
    return (
        f"CASE WHEN {x} IS NULL OR {k} IN ('', 'n/a', 'na', 'not applicable') THEN 'N/A' "
        f"{_ladder(k)} ELSE {title_fallback(x)} END"
    )


def client_status(x: str) -> str:
    k = strip(f"lower({x})")
    return (
        f"CASE WHEN {x} IS NULL OR {k} IN ('', 'n/a', 'na') THEN 'N/A' {_ladder(k)} "
        f"ELSE upper(left({k}, 1)) || substr({k}, 2) END"
    )


def patterns(x: str, table, recase, otherwise: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({x}, {sql_text('(?i)' + p)}) THEN {sql_text(recase(v))}" for p, v in table
    )
    return f"CASE {cases} ELSE {otherwise} END"


def canonical_status(x: str) -> str:
    t = f"coalesce({nz(x)}, 'N/A')"
    k = f"lower({t})"
    m = patterns(t, fv.STATUS_PATTERNS, str.title, title(t))
    return (
        f"CASE WHEN {k} IN ('positive','detected','reactive','present','pos') THEN 'Positive' "
        f"WHEN {k} IN ('negative','not detected','non reactive','absent','neg') THEN 'Negative' "
        f"WHEN contains({k},'critical') OR contains({k},'panic') THEN 'Critical' "
        f"WHEN contains({k},'high') OR {k} IN ('h','elevated','above range','borderline high') THEN 'High' "
        f"WHEN contains({k},'low') OR {k} IN ('l','decreased','below range') THEN 'Low' "
        f"WHEN contains({k},'normal') OR contains({k},'within range') OR contains({k},'within normal') THEN 'Normal' "
        f"WHEN {k} IN ('na','n/a','not applicable','none','unknown') THEN 'N/A' "
        f"WHEN {m} IN {tuple(fv.INGEST_STATUSES)} THEN {m} ELSE 'N/A' END"
    )


def weight(x: str, null_weight: int) -> str:
    cases = " ".join(f"WHEN {sql_text(k.lower())} THEN {w}" for k, w in fv.STATUS_WEIGHTS.items())
    return f"CASE WHEN {x} IS NULL THEN {null_weight} ELSE CASE lower({strip(x)}) {cases} ELSE 70 END END"


def severity3(x: str) -> str:
    s = f"lower({client_status(x)})"
    return (
        f"CASE WHEN {s} IN ('critical','high','positive','flagged') THEN 'HIGH' "
        f"WHEN {s} IN ('low','insufficient','borderline') THEN 'BORDERLINE' ELSE 'NORMAL' END"
    )


def chat_severity(x: str) -> str:
    r = f"lower({nz(x)})"
    return (
        f"CASE WHEN {r} IS NULL THEN 'UNKNOWN' WHEN contains({r},'normal') OR contains({r},'negative') OR "
        f"contains({r},'within') THEN 'NORMAL' WHEN contains({r},'high') THEN 'HIGH' WHEN contains({r},'low') "
        f"THEN 'LOW' WHEN contains({r},'critical') THEN 'CRITICAL' WHEN contains({r},'borderline') THEN "
        f"'BORDERLINE' WHEN contains({r},'positive') THEN 'POSITIVE' ELSE 'ABNORMAL' END"
    )


def isin(x: str, *members: str) -> str:
    return f"coalesce({x} IN ({', '.join(sql_text(m) for m in members)}), false)"


ABN_SCORE = lambda x: isin(x, "High", "Low", "Critical", "Positive")
ABN_CHAT = lambda x: "NOT " + isin(f"lower(coalesce({x}, ''))", "normal", "negative", "n/a", "na", "")
ABN_DASH = lambda x: isin(f"lower({x})", "high", "low", "critical", "positive", "flagged")
ABN_TREE = lambda x: isin(f"lower({x})", "high", "low", "critical", "positive", "flagged", "insufficient")
ABN_PANEL = lambda x: f"({severity3(x)} <> 'NORMAL')"
ABN_MIGR = lambda x: isin(f"lower({x})", "critical", "high", "low", "positive", "flagged", "borderline", "insufficient")
ABN_PDF = lambda x: isin(f"lower({x})", "high", "low", "critical", "positive")
GOOD = lambda x: isin(f"lower({x})", "normal", "negative")

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def strict_numeric(x: str) -> str:
    return f"CASE WHEN regexp_full_match({strip(x)}, {sql_text(NUMBER)}) THEN try_cast({strip(x)} AS DOUBLE) END"


def parse_numeric(x: str) -> str:
    return strict_numeric(f"replace({x}, ',', '')")


def leading_numeric(x: str) -> str:
    t = strip(f"replace({x}, ',', '')")
    return f"try_cast(nullif(regexp_extract({t}, {sql_text('^' + NUMBER)}), '') AS DOUBLE)"


def _d(x: str, shape: str, fmt: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '{shape}') THEN CAST(try_strptime({x}, '{fmt}') AS DATE) END"


def _d2(x: str, sep: str, pivot: bool) -> str:
    """Two-digit years: spelled out before parsing."""
    y = f"CAST(right({x}, 2) AS INTEGER)"
    century = f"CASE WHEN {y} >= 69 THEN '19' ELSE '20' END" if pivot else "'20'"
    full = f"left({x}, length({x}) - 2) || {century} || right({x}, 2)"
    return (
        f"CASE WHEN regexp_full_match({x}, '\\d{{1,2}}[{sep}]\\d{{1,2}}[{sep}]\\d{{2}}') "
        f"THEN CAST(try_strptime({full}, '%d{sep}%m{sep}%Y') AS DATE) END"
    )


DMY = lambda s: f"\\d{{1,2}}{s}\\d{{1,2}}{s}\\d{{4}}"


TIME = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def untimed(t: str) -> str:
    return f"regexp_replace({t}, '^(\\d[\\d/.\\-]*\\d){TIME}', '\\1')"


def spelled_date(t: str) -> str:
    def read(pattern, day, month):
        part = lambda g: f"regexp_extract(lower({t}), '{pattern}', {g})"
        return f"CASE WHEN regexp_full_match(lower({t}), '{pattern}') THEN CAST(try_strptime({part(day)} || ' ' || left({part(month)}, 3) || ' ' || {part(3)}, '%d %b %Y') AS DATE) END"

    return f"coalesce({read(rf'(\d{{1,2}})(?:st|nd|rd|th)?[ \-]{MONTH}[ ,\-]+(\d{{4}})', 1, 2)}, {read(rf'{MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})', 2, 1)})"


WEEKDAY = "^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?[.,]?\\s+"
ANY_MONTH = MONTH.replace("sep(?:tember)?", "sept?(?:ember)?")


def worded_date(t: str) -> str:
    def read(pattern, day, month, year):
        part = lambda g: f"regexp_extract(lower({t}), '{pattern}', {g})"
        whole = f"CASE WHEN length({part(year)}) = 2 THEN CASE WHEN {part(year)} >= '69' THEN '19' ELSE '20' END || {part(year)} ELSE {part(year)} END"
        told = part(day) if day else "'1'"
        return f"CASE WHEN regexp_full_match(lower({t}), '{pattern}') THEN CAST(try_strptime({told} || ' ' || left({part(month)}, 3) || ' ' || {whole}, '%d %b %Y') AS DATE) END"

    b, m, day, year = "[ ,./\\-]+", ANY_MONTH, "(\\d{1,2})(?:st|nd|rd|th)?", "(\\d{4}|\\d{2})"
    return f"coalesce({read(day + b + m + b + year, 1, 2, 3)}, {read(m + b + day + b + year, 2, 1, 3)}, {read('(\\d{4})' + b + m + b + day, 3, 2, 1)}, {read(m + b + '(\\d{4})', None, 1, 2)})"


def _month_first(t: str, sep: str, digits: int) -> str:
    """Month, day and a year of so many digits, the short ones from 1969 on."""
    y = f"right({t}, {digits})"
    full = y if digits == 4 else f"CASE WHEN {y} >= '69' THEN '19' ELSE '20' END || {y}"
    return f"CASE WHEN regexp_full_match({t}, '\\d{{1,2}}[{sep}]\\d{{1,2}}[{sep}]\\d{{{digits}}}') THEN CAST(try_strptime(left({t}, length({t}) - {digits}) || {full}, '%m{sep}%d{sep}%Y') AS DATE) END"


def _month_alone(t: str, shape: str, year: int, month: int) -> str:
    return f"CASE WHEN regexp_full_match({t}, '{shape}') THEN CAST(try_strptime(regexp_extract({t}, '{shape}', {year}) || '-' || regexp_extract({t}, '{shape}', {month}) || '-1', '%Y-%m-%d') AS DATE) END"


def date_day_first(x: str) -> str:
    t = untimed(f"regexp_replace({nz(x)}, '{WEEKDAY}', '', 'i')")
    parts = [
        _d(t, DMY("/"), "%d/%m/%Y"), _d(t, DMY("-"), "%d-%m-%Y"), _d(t, DMY("\\."), "%d.%m.%Y"),
        _d(t, "\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%d-%m"), _d(t, "\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"),
        *[_d(t, f"\\d{{4}}{s}\\d{{1,2}}{s}\\d{{1,2}}", f"%Y{p}{a}{p}{b}") for s, p in (("/", "/"), ("\\.", ".")) for a, b in (("%d", "%m"), ("%m", "%d"))],
        _d2(t, "/", True), _d2(t, "-", True), _d2(t, ".", True), _d(t, "\\d{8}", "%Y%m%d"), *[_month_first(t, sep, n) for n in (4, 2) for sep in "/-."],
        _month_alone(t, "(\\d{4})[/-](\\d{1,2})", 1, 2), _month_alone(t, "(\\d{1,2})[/-](\\d{4})", 2, 1), worded_date(t),
    ]
    return f"coalesce({', '.join(parts)})"


def sort_date(x: str) -> str:
    t = nz(x)
    parts = [
        _d(t, DMY("-"), "%d-%m-%Y"), _d(t, DMY("/"), "%d/%m/%Y"),
        _d(t, "\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"), _d(t, "\\d{4}/\\d{1,2}/\\d{1,2}", "%Y/%m/%d"),
        _d2(t, "-", True), _d2(t, "/", True), _d(untimed(t), "\\d{4}-\\d{2}-\\d{2}", "%Y-%m-%d"),
    ]
    return f"coalesce({', '.join(parts)})"


def report_date(x: str) -> str:
    t = nz(x)
    parts = [
        _d(t, "\\d{4}-\\d{2}-\\d{2}", "%Y-%m-%d"), _d(t, DMY("-"), "%d-%m-%Y"), _d2(t, "-", False),
        _d(t, DMY("/"), "%d/%m/%Y"), _d2(t, "/", False),
    ]
    return f"coalesce({', '.join(parts)})"


def client_date(x: str) -> str:
    t = untimed(nz(x))
    more = [_d(t, "\\d{4}-\\d{2}-\\d{2}", "%Y-%m-%d"), _d(t, "\\d{4}/\\d{1,2}/\\d{1,2}", "%Y/%m/%d"), spelled_date(nz(x))]
    return f"coalesce({report_date(x)}, {', '.join(more)})"


def fmt_date(d: str) -> str:
    return f"coalesce(strftime({d}, '%d-%m-%Y'), 'N/A')"


def _g(x: str, p: str, g: int) -> str:
    return f"try_cast(nullif(regexp_extract({x}, {sql_text(p)}, {g}), '') AS DOUBLE)"


SPAN = r"([\d.]+)\s*-\s*([\d.]+)"
BELOW = r"(?i)(?:<|Less than|upto)\s*([\d.]+)"
ABOVE = r"(?i)(?:>|Greater than|above)\s*([\d.]+)"


def range_kind(x: str) -> str:
    t = f"CASE WHEN lower({strip(x)}) IN ('', 'n/a') THEN NULL ELSE {strip(x)} END"
    return (
        f"CASE WHEN {_g(t, SPAN, 1)} IS NOT NULL AND {_g(t, SPAN, 2)} IS NOT NULL THEN 'range' "
        f"WHEN {_g(t, BELOW, 1)} IS NOT NULL THEN 'less_than' WHEN {_g(t, ABOVE, 1)} IS NOT NULL THEN 'greater_than' "
        f"WHEN lower({t}) IN ('negative','non reactive','not detected') THEN 'qualitative_normal' "
        f"WHEN lower({t}) IN ('positive','reactive','detected') THEN 'qualitative_abnormal' END"
    )


def range_low(x: str) -> str:
    return f"CASE {range_kind(x)} WHEN 'range' THEN {_g(x, SPAN, 1)} WHEN 'greater_than' THEN {_g(x, ABOVE, 1)} END"


def range_high(x: str) -> str:
    return f"CASE {range_kind(x)} WHEN 'range' THEN {_g(x, SPAN, 2)} WHEN 'less_than' THEN {_g(x, BELOW, 1)} END"


CSPAN = r"([0-9.]+)\s*[-–]\s*([0-9.]+)"
CLT = r"[<≤]\s*([0-9.]+)"
CGT = r"[>≥]\s*([0-9.]+)"


def client_low(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{CSPAN}') THEN {_g(x, CSPAN, 1)} WHEN regexp_matches({x}, '{CLT}') THEN NULL "
        f"WHEN regexp_matches({x}, '{CGT}') THEN {_g(x, CGT, 1)} END"
    )


def client_high(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{CSPAN}') THEN {_g(x, CSPAN, 2)} "
        f"WHEN regexp_matches({x}, '{CLT}') THEN {_g(x, CLT, 1)} END"
    )


def deviation(v: str, lo: str, hi: str, sev: str) -> str:
    d = f"CASE {sev} WHEN 'HIGH' THEN 20 WHEN 'BORDERLINE' THEN 8 ELSE 0 END"
    under = f"floor(({lo} - {v}) / nullif(abs({lo}), 0) * 100 + 0.5)"
    over = f"floor(({v} - {hi}) / nullif(abs({hi}), 0) * 100 + 0.5)"
    return (
        f"CAST(CASE WHEN {v} IS NULL THEN {d} WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN "
        f"(CASE WHEN {v} < {lo} AND {lo} <> 0 THEN {under} WHEN {v} > {hi} AND {hi} <> 0 THEN {over} ELSE 0 END) "
        f"WHEN {v} > {hi} AND {hi} <> 0 THEN {over} WHEN {v} < {lo} AND {lo} <> 0 THEN {under} ELSE {d} END AS BIGINT)"
    )


def completeness() -> str:
    return (
        f"(CASE WHEN {parse_numeric('\"Result\"')} IS NOT NULL THEN 2 ELSE 0 END + "
        f"CASE WHEN {nz('\"Reference_Range\"')} IS NOT NULL THEN 2 ELSE 0 END + "
        f"CASE WHEN {nz('\"Unit\"')} IS NOT NULL THEN 1 ELSE 0 END + "
        f"CASE WHEN lower({nz('\"Status\"')}) <> 'n/a' THEN 1 ELSE 0 END)"
    )


def file_key(x: str) -> str:
    return f"coalesce(lower({strip(f'list_last(string_split(replace({x}, chr(92), chr(47)), chr(47)))')}), '')"


def file_stem(k: str) -> str:
    return f"CASE WHEN regexp_matches({k}, '^.+\\.[^.]+$') THEN regexp_replace({k}, '\\.[^.]+$', '') ELSE {k} END"


def person(x: str) -> str:
    n = strip(f"lower({x})")
    for t in fv.NAME_TITLE_PATTERNS:
        n = rr(n, rf"\b{t}\b\.?\s*")
    titled = f"array_to_string(list_transform({words(n)}, lambda w2_: {title('w2_')}), ' ')"
    return f"CASE WHEN {x} IS NULL OR {x} = 'N/A' THEN '' ELSE {titled} END"


def persons_match(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    shared = f"len(list_intersect({x}, {y}))"
    total = f"len(list_distinct(list_concat({x}, {y})))"
    return (
        f"({a} = '' OR {b} = '' OR list_has_all({x}, {y}) OR list_has_all({y}, {x}) OR "
        f"({shared} >= 2 AND {shared} / {total} >= 0.6))"
    )


def clean_lab(x: str) -> str:
    lab = strip(x)
    split = " ".join(
        f"WHEN contains({lab}, {sql_text(s)}) THEN string_split({lab}, {sql_text(s)})" for s in fv.LAB_SEPARATORS
    )
    bad = " OR ".join(f"contains(lower(p1_), {sql_text(t)})" for t in fv.BILLING_TERMS)
    kept = (
        f"list_filter(CASE {split} ELSE [{lab}] END, lambda p1_: NOT ({bad}) AND length({strip('p1_')}) > 2 "
        f"AND NOT regexp_full_match({strip('p1_')}, '\\d+'))"
    )
    trimmed = f"list_transform({kept}, lambda p2_: {strip('p2_')})"
    longest = let(
        trimmed, "l_",
        "list_filter(l_, lambda e_: length(e_) = list_max(list_transform(l_, lambda f_: length(f_))))[1]",
    )
    return f"CASE WHEN {x} IS NULL OR {x} = 'N/A' THEN 'Unknown Lab' ELSE coalesce({longest}, {lab}) END"


def query_text(x: str) -> str:
    return strip(rr(rr(f"lower({x})", r"[^a-z0-9%+\-\s]", " "), r"\s+", " "))


def query_tokens(x: str) -> str:
    return (
        f"list_filter(string_split({query_text(x)}, ' '), lambda q_: length(q_) > 1 "
        f"AND NOT list_contains({sql_list(fv.STOP_WORDS)}, q_))"
    )


def grouping_name(x: str) -> str:
    n = rr(rr(f"lower({strip(x)})", r"\([^)]*\)"), r"\s*-\s*", "-")
    for w in fv.TRAILING_WORDS:
        n = rr(n, rf"[\s-]*\b{w}\b$")
    n = f"trim({rr(rr(n, r'[^a-z0-9\s-]'), r'\s+', ' ')}, ' -')"
    return let(
        f"coalesce({n}, 'N/A')", "g_",
        "CASE WHEN g_ LIKE '%_s' AND g_ NOT LIKE '%ss' THEN left(g_, length(g_) - 1) ELSE g_ END",
    )


def chat_key(x: str) -> str:
    return strip(rr(rr(f"lower({x})", r"[^a-z0-9\s]", " "), r"\s+", " "))


def lower_better(x: str) -> str:
    k = rr(f"lower({x})", "[^a-z0-9]")
    return f"(len(list_filter({sql_list(fv.LOWER_IS_BETTER)}, lambda b_: contains({k}, b_))) > 0)"


def client_key(x: str) -> str:
    k = rr(rr(rr(strip(f"lower({x})"), "[()]"), "_+", " "), r"\s*/\s*", " / ")
    return strip(rr(rr(k, r"[^a-z0-9\-&/+\s]", " "), r"\s+", " "))


def name_score(x: str) -> str:
    return let(
        x, "n_",
        f"length(n_) + CASE WHEN regexp_matches(n_, '\\(.*\\)') AND "
        f"len(list_filter({words('n_')}, lambda a_: length(a_) > 4)) > 0 THEN 20 ELSE 0 END "
        f"- CASE WHEN {rr('n_', '[^A-Za-z]')} <> '' AND {rr('n_', '[^A-Za-z]')} = upper({rr('n_', '[^A-Za-z]')}) THEN 15 ELSE 0 END "
        f"- CASE WHEN len({words('n_')}) > 0 AND len(list_filter({words('n_')}, lambda a_: length({rr('a_', '[^A-Za-z]')}) > 4)) = 0 "
        f"THEN 20 ELSE 0 END",
    )


def missing(x: str) -> str:
    return f"({x} IS NULL OR {strip(f'lower({x})')} IN ('', 'n/a', 'na', 'none'))"


# --- shared views -----------------------------------------------------------
def values_view(name: str, cols: str, rows: list[tuple]) -> None:
    body = ", ".join("(" + ", ".join(v if isinstance(v, str) and v.startswith("\0") else (str(v) if isinstance(v, int) else sql_text(v)) for v in r) + ")" for r in rows)
    SQL.add(name, f"SELECT * FROM (VALUES {body}) AS t({cols})")


values_view("alias_raw", "ord, alias, canonical", [(i, a, c) for i, (a, c) in enumerate(fv.TEST_NAME_MAP)])
SQL.add("alias_t", f"SELECT *, {lookup_key('alias')} AS lk, {compact('alias')} AS ck, {client_key('alias')} AS clk FROM alias_raw", "alias_raw")
SQL.add("alias_lk", f"SELECT lk, min(ord) AS ord, arg_max(canonical, ord) AS canonical, {compact('lk')} AS ck FROM alias_t WHERE lk <> '' GROUP BY lk", "alias_t")
SQL.add("alias_cl", f"SELECT clk, min(ord) AS ord, arg_max(canonical, ord) AS canonical, replace(clk, ' ', '') AS cck FROM alias_t GROUP BY clk", "alias_t")
values_view("category_t", "ord, k, v", [(i, k, v) for i, (k, v) in enumerate(fv.CATEGORY_MAP)])
values_view("hint_raw", "ord, h, cat", [(i, k, v) for i, (k, v) in enumerate(fv.TEST_CATEGORY_HINTS)])
values_view("body_t", "category, part, ord", [(c, p, i) for c, ps in fv.BODY_PARTS for i, p in enumerate(ps)])


def from_lookup(key: str) -> str:
    """Canonical name of a cleaned key through the alias table, else null."""
    return (
        f"coalesce((SELECT a.canonical FROM alias_lk a WHERE a.lk = {lookup_key(key)}), "
        f"(SELECT arg_min(a.canonical, a.ord) FROM alias_lk a WHERE a.ck = {compact(lookup_key(key))}))"
    )


def known_name(key: str) -> str:
    return (
        f"coalesce((SELECT a.canonical FROM alias_t a WHERE a.alias = {key}), "
        f"(SELECT a.canonical FROM alias_lk a WHERE a.lk = {lookup_key(key)}), "
        f"(SELECT arg_min(a.canonical, a.ord) FROM alias_t a WHERE a.ck = {compact(key)}), "
        f"(SELECT arg_min(a.canonical, a.ord) FROM alias_lk a WHERE a.ck = {compact(key)}), {display_name(key)})"
    )


SQL.add("name_raw", f"""SELECT DISTINCT coalesce({strip('coalesce(nullif("Original_Test_Name", chr(0)), "Test_Name")')}, '') AS raw FROM lab_records""", "lab_records")
SQL.add("name_key", f"SELECT raw, {structural_clean('raw')} AS key FROM name_raw", "name_raw")
SQL.add("name_std", f"SELECT raw, key, CASE WHEN {missing('raw')} THEN 'Unknown Test' ELSE {known_name('key')} END AS test_name FROM name_key", "name_key", "alias_t", "alias_lk")
SQL.add("name_cl", f"SELECT *, {structural_clean('test_name')} AS tkey FROM name_std", "name_std")
SQL.add("name_known", f"SELECT *, {from_lookup('tkey')} AS known FROM name_cl", "name_cl", "alias_lk")
SQL.add("hint_t", f"SELECT *, {from_lookup('h')} AS known FROM hint_raw", "hint_raw", "alias_lk")
SQL.add("name_map", f"""SELECT raw, key, test_name, coalesce('c:' || known, 'k:' || tkey) AS cluster,
  (SELECT arg_min(h.cat, h.ord) FROM hint_t h WHERE contains(tkey, h.h) OR contains(h.h, tkey) OR h.known = name_known.known) AS hint,
  {name_score("CASE WHEN raw = '' THEN 'Unknown Test' ELSE raw END")} AS score FROM name_known""", "name_known", "hint_t")
SQL.add("cat_raw", 'SELECT DISTINCT "Test_Category" AS raw FROM lab_records', "lab_records")
SQL.add("cat_key", f"SELECT raw, {lookup_key('raw')} AS key FROM cat_raw", "cat_raw")
SQL.add("cat_map", f"""SELECT raw, CASE WHEN {missing('raw')} THEN 'Other' ELSE coalesce(
  (SELECT c.v FROM category_t c WHERE c.k = cat_key.key),
  (SELECT arg_min(c.v, c.ord) FROM category_t c WHERE contains(c.k, cat_key.key) OR contains(cat_key.key, c.k)), 'Other') END AS category FROM cat_key""", "cat_key", "category_t")
SQL.add("normalized", f"""SELECT r.scope_id, r.study_id, r.report_id, r.row_ord, r."Source_Filename", r."Patient_ID", r."Patient_Name", r."Age",
  r."Gender", r."Test_Date", r."Lab_Name", c.category AS "Test_Category", nullif(n.raw, '') AS "Original_Test_Name", n.test_name AS "Test_Name",
  r."Result", r."Unit", r."Reference_Range", {normalize_status('r."Status"')} AS "Status", n.cluster, n.hint, n.score,
  CASE WHEN n.raw = '' OR n.raw = n.test_name THEN [n.test_name] ELSE [n.raw, n.test_name] END AS "Aliases"
  FROM lab_records r JOIN name_map n ON n.raw = coalesce({strip('r."Original_Test_Name"')}, '')
  JOIN cat_map c ON c.raw IS NOT DISTINCT FROM r."Test_Category" """, "lab_records", "name_map", "cat_map")
PRIO = "CASE \"Test_Category\" " + " ".join(f"WHEN {sql_text(k)} THEN {v}" for k, v in fv.CATEGORY_PRIORITY.items()) + " ELSE 0 END"


def resolved_views(prefix: str, source: str, scope: str) -> None:
    """Deduplication of ``source`` within ``scope`` (comma separated columns)."""
    SQL.add(f"{prefix}_votes", f"""SELECT {scope}, cluster, "Test_Category" AS cat, row_number() OVER (PARTITION BY {scope}, cluster
      ORDER BY {PRIO} DESC, count(*) DESC, min(row_ord)) AS rk FROM {source} WHERE "Test_Category" <> 'Other' GROUP BY {scope}, cluster, "Test_Category" """, source)
    SQL.add(f"{prefix}_pick", f"""SELECT {scope}, cluster, arg_min("Test_Name", ROW(-score, row_ord)) AS name, arg_min(hint, ROW(-score, row_ord)) AS hint FROM
      (SELECT *, coalesce(hint, NULL) AS h2 FROM {source}) GROUP BY {scope}, cluster""", source)
    SQL.add(f"{prefix}_al", f"""SELECT {scope}, cluster, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM
      (SELECT {scope}, cluster, unnest("Aliases") AS a FROM {source}) GROUP BY {scope}, cluster""", source)
    SQL.add(f"{prefix}_best", f"""SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {scope}, cluster, coalesce({nz('"Test_Date"')}, 'N/A')
      ORDER BY CASE WHEN {parse_numeric('"Result"')} IS NULL THEN 1 ELSE 0 END, {completeness()} DESC, coalesce(length("Reference_Range"), 0) DESC,
      coalesce(length("Unit"), 0) DESC, row_ord) = 1""", source)
    on = lambda t: " AND ".join(f"b.{s.strip()} = {t}.{s.strip()}" for s in (scope + ",cluster").split(","))
    SQL.add(f"{prefix}", f"""SELECT b.* EXCLUDE ("Test_Name", "Test_Category", "Aliases", "Original_Test_Name", cluster, hint, score),
      coalesce(b."Original_Test_Name", b."Test_Name") AS "Original_Test_Name", p.name AS "Test_Name",
      coalesce(p.hint, v.cat, 'Other') AS "Test_Category", a.aliases
      FROM {prefix}_best b JOIN {prefix}_pick p ON {on('p')} LEFT JOIN {prefix}_votes v ON {on('v')} AND v.rk = 1
      JOIN {prefix}_al a ON {on('a')}""", f"{prefix}_best", f"{prefix}_pick", f"{prefix}_votes", f"{prefix}_al")


resolved_views("resolved", "normalized", "scope_id")
SQL.add("client_raw", f"SELECT raw, {client_key('raw')} AS key FROM name_raw", "name_raw")
SQL.add("client_names", f"""SELECT raw, CASE WHEN {nz('raw')} IS NULL THEN 'Unknown Test' ELSE coalesce(
  (SELECT a.canonical FROM alias_t a WHERE a.alias = n.key), (SELECT a.canonical FROM alias_cl a WHERE a.clk = n.key),
  (SELECT arg_min(a.canonical, a.ord) FROM alias_cl a WHERE a.cck = replace(n.key, ' ', '')),
  (SELECT arg_min(a.canonical, a.ord) FROM alias_cl a WHERE contains(a.clk, 'ratio') = contains(n.key, 'ratio')
     AND least(length(a.cck), length(replace(n.key, ' ', ''))) >= 8
     AND ((length(replace(n.key, ' ', '')) <= length(a.cck) AND starts_with(a.cck, replace(n.key, ' ', '')))
       OR (length(replace(n.key, ' ', '')) > length(a.cck) AND starts_with(replace(n.key, ' ', ''), a.cck))
       OR (len(string_split(n.key, ' ')) <= len(string_split(a.clk, ' ')) AND len(string_split(n.key, ' ')) >= 2 AND list_has_all(string_split(a.clk, ' '), string_split(n.key, ' ')))
       OR (len(string_split(n.key, ' ')) > len(string_split(a.clk, ' ')) AND len(string_split(a.clk, ' ')) >= 2 AND list_has_all(string_split(n.key, ' '), string_split(a.clk, ' '))))),
  array_to_string(list_transform({words(strip('raw'))}, lambda w3_: {capitalize('w3_')}), ' ')) END AS name FROM client_raw n""", "client_raw", "alias_t", "alias_cl")
