"""Patient details of many reports consolidated to one line per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions.basic import na

from labtrail.functions.basic import n_rows

from labtrail.functions import text as tx
from labtrail.functions import values as va
from labtrail.operators.resolve import ORDER, SCOPE
from labtrail.schema import PATIENT_FIELDS
from labtrail.session import materialize

#: Share of the words of two names that one person's names have in common (``persons_match``).
PERSON_OVERLAP = 0.6


def given(c: Column) -> Column:
    """The value when it is really given, else null."""
    return F.when(~c.isin("", "N/A"), c)


def value_counts(infos: DataFrame, fields: list[str]) -> DataFrame:
    """How often, and where first, each value of each field occurs."""
    long = infos.select(SCOPE, ORDER, *[given(F.col(f)).alias(f) for f in fields]).unpivot(
        [SCOPE, ORDER], fields, "field", "value"
    )
    return long.where("value IS NOT NULL").groupBy(SCOPE, "field", "value").agg(
        n_rows().alias("n"), F.min(ORDER).alias("first")
    )


def first_seen_modes(counts: DataFrame, fields: list[str]) -> DataFrame:
    """Most frequent value per field; the first seen wins a tie."""
    pick = lambda f: F.min_by(
        "value", F.when(F.col("field") == f, F.struct((-F.col("n")).alias("n"), F.col("first").alias("o")))
    ).alias(f)
    return counts.groupBy(SCOPE).agg(*[pick(f) for f in fields])


def names_by_use(infos: DataFrame, keep_empty: bool) -> DataFrame:
    """Most frequent normalized name, longest, then first seen."""
    named = infos.select(SCOPE, ORDER, tx.normalize_person(given(F.col("name"))).alias("n")).where(
        given(infos["name"]).isNotNull()
    )
    if not keep_empty:
        named = named.where("n <> ''")
    counts = named.groupBy(SCOPE, "n").agg(n_rows().alias("c"), F.min(ORDER).alias("o"))
    return counts.groupBy(SCOPE).agg(
        F.min_by("n", F.struct(-F.col("c"), -F.length("n"), F.col("o"))).alias("name")
    )


def dated_facts(infos: DataFrame) -> DataFrame:
    """Age on the latest dated report, first given age, latest date."""
    day = va.parse_date_day_first(given(F.col("date")))
    age = given(F.col("age"))
    usable = day.isNotNull() & age.isNotNull()
    return infos.groupBy(SCOPE).agg(
        F.min_by("age", F.when(usable, F.struct((-F.unix_date(day)).alias("d"), F.col(ORDER).alias("o")))).alias("dated_age"),
        F.min_by("age", F.when(age.isNotNull(), F.col(ORDER))).alias("first_age"),
        F.max(day).alias("day"),
        F.max(given(F.col("date")).isNotNull()).alias("has_date"),
    )


def latest_line(infos: DataFrame) -> DataFrame:
    """The whole patient line of the most recent dated report; the first one on a tie."""
    day = va.parse_date_day_first(given(F.col("date")))
    line = F.struct(*[c for c in infos.columns if c != SCOPE])
    at = F.when(day.isNotNull(), F.struct((-F.unix_date(day)).alias("d"), F.col(ORDER).alias("o")))
    return infos.groupBy(SCOPE).agg(F.min_by(line, at).alias("r")).where("r IS NOT NULL").select(SCOPE, "r.*")


def consolidate(infos: DataFrame, smart: bool = False) -> DataFrame:
    """One patient line per scope.  ``smart`` is the rule used after a name
    conflict: empty normalized names are ignored and an age needs a date."""
    modes = first_seen_modes(value_counts(infos, ["gender", "patient_id", "lab_name", "age"]), ["gender", "patient_id", "lab_name", "age"])
    joined = dated_facts(infos).join(names_by_use(infos, not smart), SCOPE, "left").join(
        modes.withColumnRenamed("age", "common_age"), SCOPE, "left"
    )
    age = F.coalesce("dated_age", "common_age", na())
    if smart:
        age = F.when(F.col("has_date"), age).otherwise(na())
    return joined.select(
        SCOPE, F.coalesce("name", na()).alias("name"), age.alias("age"), F.coalesce("gender", na()).alias("gender"),
        F.coalesce("patient_id", na()).alias("patient_id"), va.format_day_first(F.col("day")).alias("date"),
        F.coalesce("lab_name", na()).alias("lab_name"),
    )


def merge_with_existing(existing: DataFrame, infos: DataFrame) -> DataFrame:
    """New details beat existing ones field by field; the laboratory is voted
    over both and the date is the latest of both."""
    new = dated_facts(infos).join(names_by_use(infos, True), SCOPE, "left").join(
        first_seen_modes(value_counts(infos, ["gender", "patient_id"]), ["gender", "patient_id"]), SCOPE, "left"
    )
    labs = infos.select(SCOPE, ORDER, "lab_name").unionByName(
        existing.select(SCOPE, F.lit("￿").alias(ORDER), "lab_name")
    )
    lab = first_seen_modes(value_counts(labs, ["lab_name"]), ["lab_name"]).withColumnRenamed("lab_name", "any_lab")
    old = existing.select(SCOPE, *[F.col(f).alias(f"old_{f}") for f in PATIENT_FIELDS])
    j = old.join(new, SCOPE, "full_outer").join(lab, SCOPE, "left")
    old_day = va.parse_date_day_first(given(F.col("old_date")))
    # without any new report the existing line stays as it is
    untouched = F.col("has_date").isNull()
    pick = lambda f, new_value: F.coalesce(F.when(untouched, F.col(f"old_{f}")), new_value, F.col(f"old_{f}"), na()).alias(f)
    return j.select(
        SCOPE, pick("name", F.col("name")), pick("age", F.coalesce("dated_age", "first_age")),
        pick("gender", F.col("gender")), pick("patient_id", F.col("patient_id")),
        F.coalesce(F.when(untouched, F.col("old_date")), va.format_day_first(F.greatest("day", old_day))).alias("date"),
        F.coalesce(F.when(untouched, F.col("old_lab_name")), "any_lab", na()).alias("lab_name"),
    )


def from_records(records: DataFrame) -> DataFrame:
    """Patient line read off a record table; the smallest value wins a tie."""
    cols = {"name": "Patient_Name", "age": "Age", "gender": "Gender", "patient_id": "Patient_ID", "lab_name": "Lab_Name"}
    reduced = records.groupBy(SCOPE, *cols.values()).agg(
        n_rows().alias("rows"), F.max(va.parse_date_day_first(F.col("Test_Date"))).alias("day")
    )
    # one pass over the reduced lines, then one vote per field
    long = reduced.select(
        SCOPE, "rows", F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.when(F.col(c) != "N/A", F.col(c)).alias("value")) for f, c in cols.items()
        ])).alias("e"),
    ).select(SCOPE, "rows", "e.*").where("value IS NOT NULL")
    counts = long.groupBy(SCOPE, "field", "value").agg(F.sum("rows").alias("n"))
    votes = counts.groupBy(SCOPE).agg(*[
        F.min_by("value", F.when(F.col("field") == f, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))).alias(f)
        for f in cols
    ])
    days = reduced.groupBy(SCOPE).agg(F.max("day").alias("day"))
    return days.join(votes, SCOPE, "left").select(
        SCOPE, *[F.coalesce(f, na()).alias(f) for f in cols], va.format_day_first(F.col("day")).alias("date")
    )


# --- name conflicts ---------------------------------------------------------
def distinct_names(infos: DataFrame) -> DataFrame:
    """Distinct normalized names with the first report that used each."""
    raw = given(F.col("name"))
    return (
        infos.where(raw.isNotNull()).select(SCOPE, ORDER, "name", tx.normalize_person(F.col("name")).alias("norm"))
        .where("norm <> ''").groupBy(SCOPE, "norm")
        .agg(F.min(ORDER).alias("first"), F.min_by("name", ORDER).alias("shown"))
    )


def clash_bounds(names: DataFrame) -> DataFrame:
    """``names`` (scope, norm) with ``names_``, the names of its scope, and ``like``, at least as many as may match it, itself included.

    A name that matches either shares six tenths of this one's words, so it
    holds one of this one's rarest words; or all its words are among this one's,
    so its own rarest word is.  Names that share no word never match.
    """
    words = F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != ""))
    each = names.select(SCOPE, "norm", F.explode(words).alias("word"))
    held = each.groupBy(SCOPE, "word").agg(n_rows().alias("df"))
    ranked = each.join(held, [SCOPE, "word"]).groupBy(SCOPE, "norm").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    owned = ranked.groupBy(SCOPE, F.col("w")[0]["word"].alias("word")).agg(n_rows().alias("own"))
    subsets = each.join(owned, [SCOPE, "word"]).groupBy(SCOPE, "norm").agg(F.sum("own").alias("subsets"))
    k = F.size("w")
    rarest = F.slice("w", F.lit(1), k - F.ceil(k * PERSON_OVERLAP - 1e-9).cast("int") + 1)
    sharing = F.aggregate(rarest, F.lit(0).cast("long"), lambda acc, x: acc + x["df"])
    sizes = names.groupBy(SCOPE).agg(n_rows().alias("names_"))
    return names.join(ranked, [SCOPE, "norm"]).join(subsets, [SCOPE, "norm"], "left").join(sizes, SCOPE).withColumn(
        "like", sharing + F.coalesce("subsets", F.lit(0))
    ).drop("w", "subsets")


def name_conflicts(infos: DataFrame) -> DataFrame:
    """First pair of names per scope that cannot be one person.

    Counts of words tell, without comparing names, which surely clash with
    another (``clash_bounds``).  The first such name is the last that the pair
    can begin with, so only names up to it are compared with those after them.
    """
    names = materialize(distinct_names(infos), "patient-names")
    bounds = clash_bounds(names).where("names_ > 1")
    sure = bounds.groupBy(SCOPE).agg(F.min(F.when(F.col("like") < F.col("names_"), F.col("first"))).alias("last"))
    a = names.join(sure, SCOPE).where("last IS NULL OR first <= last").alias("a")
    b = names.alias("b")
    clash = (F.col("a.first") < F.col("b.first")) & ~tx.persons_match(F.col("a.norm"), F.col("b.norm"))
    pair = F.struct(F.col("a.first").alias("i"), F.col("b.first").alias("j"), F.col("a.shown").alias("x"), F.col("b.shown").alias("y"))
    found = a.join(b, (F.col(f"a.{SCOPE}") == F.col(f"b.{SCOPE}")) & clash).groupBy(F.col(f"a.{SCOPE}").alias(SCOPE)).agg(F.min(pair).alias("p"))
    return found.select(SCOPE, F.col("p.x").alias("first_name"), F.col("p.y").alias("conflicting_name"))
