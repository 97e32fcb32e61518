"""Extraction quality, chat quality and telemetry roll-ups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.functions.basic import n_rows

from labtrail.functions import status as st
from labtrail.functions import text as tx
from labtrail.session import materialize



# --- extracted findings against the truth -----------------------------------
#: Findings of a chain that one task matches, about; a stretch of values, in tolerances, that is never cut.
SEGMENT, UNCUT = 100_000, 8
#: What a value may have instead of a truth: none is left, or an earlier value is undecided.
NONE, WAITS = -1, -2


def both_sides(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """Extracted findings (side 0) and true ones (side 1) as one table, written since it is read several times."""
    sides = extracted.select("report_id", "name", "value", "pos", F.lit(0).alias("side")).unionByName(
        truth.select("report_id", "name", "value", "pos", F.lit(1).alias("side"))
    )
    return materialize(sides, "findings")


def greedy_matches(extracted: DataFrame, truth: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One-to-one matches per report: same name, values closer than tolerance,
    extracted findings in input order, each taking its first unused truth.

    Both inputs: (report_id, name, value, pos).  Findings that are equal as
    (report, name, value) behave alike, so whole runs of equal values are
    matched by counting.  Only chains of *different* values within tolerance
    need the sequential rule; a chain is cut wherever two neighbouring values
    differ by the tolerance or more.
    """
    return matches_of_sides(both_sides(extracted, truth), tolerance)


def matches_of_sides(sides: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """:func:`greedy_matches` of the table that :func:`both_sides` writes."""
    # one line per distinct value, however many findings share it
    points = sides.groupBy("report_id", "name", "value").agg(
        F.sum(1 - F.col("side")).alias("n_extracted"), F.sum("side").alias("n_truth")
    )
    w = Window.partitionBy("report_id", "name").orderBy("value")
    step = F.col("value") - F.lag("value").over(w)
    chained = points.withColumn("_new", F.coalesce((step >= tolerance).cast("int"), F.lit(1))).withColumn(
        "chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    shape = chained.groupBy("report_id", "name", "chain").agg(
        n_rows().alias("values"), F.sum("n_extracted").alias("e"), F.sum("n_truth").alias("t")
    )
    simple = shape.where("values = 1").select("report_id", F.least("e", "t").alias("matches"))
    tangled = (
        chained.join(shape.where("values > 1 AND e > 0 AND t > 0").select("report_id", "name", "chain"), ["report_id", "name", "chain"])
        .select("report_id", "name", "chain", "value")
        .join(sides, ["report_id", "name", "value"])
    )
    keys = ["report_id", "name", "chain"]
    tangled = materialize(tangled, "tangled-findings")
    long = materialize(tangled.groupBy(*keys).agg(n_rows().alias("n")).where(F.col("n") > SEGMENT).select(*keys), "long-chains")
    # chains of a segment or less: one pass over sorted rows, one chain in memory at a time
    short = tangled.join(long, keys, "left_anti").repartition(*keys).sortWithinPartitions(*keys, F.desc("side"), "pos")
    by_chain = short.select(*keys, "side", "value").mapInArrow(_sweep_chains(tolerance), "report_id long, matches long")
    by_segment = chain_matches(tangled.join(long, keys, "left_semi"), tolerance).select("report_id", F.lit(1).cast("long").alias("matches"))
    return simple.unionByName(by_chain).unionByName(by_segment).groupBy("report_id").agg(F.sum("matches").alias("true_positives"))


def match_in_order(values: list[float], beside: list[bool], truths: list[float], order: list[int], tolerance: float) -> list[int]:
    """For each extracted value the truth it takes (its place among the sorted ``truths``), ``NONE`` or ``WAITS``.

    ``order`` lists the truths' places from the earliest on.  Values ``beside``
    the segment are undecided, and so is any value that one of them, or another
    undecided one, before it could matter to."""
    free, blocked, out = _FirstFree(order), [], []
    for v, outside in zip(values, beside):
        at = bisect_left(blocked, v - 2 * tolerance) if blocked else 0
        if outside or (at < len(blocked) and blocked[at] <= v + 2 * tolerance):
            insort(blocked, v)
            out.append(WAITS)
            continue
        lo, hi = bisect_left(truths, v - 2 * tolerance), bisect_right(truths, v + 2 * tolerance)
        while lo < hi and not abs(v - truths[lo]) < tolerance:
            lo += 1
        while lo < hi and not abs(v - truths[hi - 1]) < tolerance:
            hi -= 1
        taken = free.take(lo, hi)
        out.append(NONE if taken is None else taken)
    return out


def _sweep_chains(tolerance: float):
    """Matches of whole chains; rows come sorted by chain, truths first, each side in input order."""

    def matches(truths: list[float], values: list[float]) -> int:
        places = sorted(range(len(truths)), key=truths.__getitem__)
        order = [0] * len(truths)
        for place, k in enumerate(places):
            order[k] = place
        return sum(x >= 0 for x in match_in_order(values, [False] * len(values), [truths[k] for k in places], order, tolerance))

    def run(batches):
        import pyarrow as pa

        chain, truths, values = None, [], []
        for batch in batches:
            found = []
            for *key, side, value in zip(*(c.to_pylist() for c in batch.columns)):
                if key != chain:
                    if values and truths:
                        found.append((chain[0], matches(truths, values)))
                    chain, truths, values = key, [], []
                (truths if side else values).append(value)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["report_id", "matches"])
        if values and truths:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (chain[0], matches(truths, values))], names=["report_id", "matches"])

    return run


def segments(tangled: DataFrame, tolerance: float) -> DataFrame:
    """Rows of chains with ``seg``, their segment of the chain's value axis, and ``low`` / ``high``, the segment's borders."""
    chain, width = ["report_id", "name", "chain"], UNCUT * tolerance
    rows = tangled.withColumn("bucket", F.floor(F.col("value") / width))
    sums = Window.partitionBy(*chain).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.groupBy(*chain, "bucket").agg(n_rows().alias("n")).withColumn("_filled", F.floor((F.sum("n").over(sums) - 1) / SEGMENT))
    # neighbours have neighbouring numbers
    cut = cut.withColumn("seg", F.dense_rank().over(Window.partitionBy(*chain).orderBy("_filled")).cast("long")).drop("_filled")
    one = Window.partitionBy(*chain, "seg")
    cut = cut.withColumn("low", F.min("bucket").over(one) * width).withColumn("high", (F.max("bucket").over(one) + 1) * width)
    return rows.join(cut.drop("n"), [*chain, "bucket"]).drop("bucket")


def chain_matches(tangled: DataFrame, tolerance: float) -> DataFrame:
    """The matched extracted findings of chains: (report_id, name, chain, value, pos).

    The rule looks at values less than two tolerances apart only.  So a long
    chain is cut into segments along its values, and each is swept by itself, in
    input order, with the findings beside its borders in view.  A finding near a
    border waits while an earlier one across it is undecided; what waits goes on
    in the next round, with what the others decided.  The earliest undecided
    finding never waits, and chains of one segment are done in one round.
    """
    chain = ["report_id", "name", "chain"]
    spark = tangled.sparkSession
    # equal rows of a side are told apart by a number
    number = F.row_number().over(Window.partitionBy(*chain, "side", "value").orderBy("pos"))
    left = materialize(segments(tangled, tolerance).withColumn("copy", number), "chain-rows")
    near = F.lit(2 * tolerance * (1 + 1e-6) + 1e-12)
    view = lambda seg, beside: F.struct(seg.alias("view"), F.lit(beside).alias("beside"))
    views = F.array_compact(F.array(
        view(F.col("seg"), False),
        F.when(F.col("value") < F.col("low") + near, view(F.col("seg") - 1, True)),
        F.when(F.col("value") >= F.col("high") - near, view(F.col("seg") + 1, True)),
    ))
    named = [*chain, "side", "value", "pos", "copy"]
    schema = T.StructType([left.schema[c] for c in named] + [T.StructField("matched", T.BooleanType())])
    done = spark.createDataFrame([], schema)
    while not left.where("side = 0").isEmpty():
        seen = left.withColumn("v", F.explode(views)).select(*named, "v.view", "v.beside")
        decided = materialize(seen.groupBy(*chain, "view").applyInPandas(_sweep(tolerance), schema), "chain-decided")
        done = done.unionByName(decided.where("matched and side = 0"))
        left = materialize(left.join(decided.select(*named), named, "left_anti"), "chain-rows")
    return done.select(*chain, "value", "pos")


def _sweep(tolerance: float):
    """Decides a segment's extracted findings in input order, as far as its borders allow."""

    def run(key, pdf):
        truths = pdf[pdf.side == 1].sort_values(["value", "pos", "copy"])
        order = truths.reset_index(drop=True).sort_values(["pos", "copy"]).index.tolist()
        asked = pdf[pdf.side == 0].sort_values(["pos", "copy"])
        found = match_in_order(asked.value.tolist(), asked.beside.tolist(), truths.value.tolist(), order, tolerance)
        decided = [(i, x >= 0) for i, x in zip(asked.index, found) if x != WAITS]
        used = [truths.index[x] for x in found if x >= 0]
        out = pdf.loc[[i for i, _ in decided] + used, ["report_id", "name", "chain", "side", "value", "pos", "copy"]]
        return out.assign(matched=[m for _, m in decided] + [True] * len(used))

    return run


class _FirstFree:
    """The places of a list that are free, and the earliest of a slice of them: a tree of minima."""

    def __init__(self, order: list[int]):
        """``order``: the places from the earliest on."""
        n = len(order)
        self.size, self.none, self.order = max(1, n), n, order
        rank = [n] * n
        for r, place in enumerate(order):
            rank[place] = r
        self.tree = [n] * self.size + rank + [n] * (self.size - n)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def take(self, lo: int, hi: int) -> int | None:
        best, lo, hi = self.none, lo + self.size, hi + self.size
        while lo < hi:
            if lo & 1:
                best = min(best, self.tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo // 2, hi // 2
        if best == self.none:
            return None
        place = self.order[best]
        k = place + self.size
        self.tree[k] = self.none
        while k > 1:
            k //= 2
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        return place


def extraction_f1(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    sides = both_sides(extracted, truth)
    sizes = sides.groupBy("report_id").agg(F.sum(1 - F.col("side")).alias("e"), F.sum("side").alias("t"))
    out = sizes.join(matches_of_sides(sides), "report_id", "left")
    tp = F.coalesce("true_positives", F.lit(0))
    precision = F.when(F.col("e") > 0, tp / F.col("e")).otherwise(0.0)
    recall = F.when(F.col("t") > 0, tp / F.col("t")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select(
        "report_id", tp.alias("true_positives"), (F.col("e") - tp).alias("false_positives"),
        (F.col("t") - tp).alias("false_negatives"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


# --- values that the source text does not contain ---------------------------
_RUN = r"[0-9.eE+\-]*[0-9][0-9.eE+\-]*"


def numeric_runs(text: Column) -> Column:
    """Distinct number-like runs of a text, joined.  A printed number occurs in
    the text exactly when it occurs inside one of its runs, so the runs stand
    in for the text and are what travels to the findings."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))), " ")


def unsupported_values(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings whose value (as printed, with one or two decimals) is absent
    from the text of their report; ``reason`` tells those of reports that have
    no text at all."""
    runs = texts.select("report_id", numeric_runs(F.col("text")).alias("_runs"))
    j = findings.where(F.col("value").isNotNull()).join(runs, "report_id", "left")
    forms = [F.col("shown"), F.format_string("%.1f", "value"), F.format_string("%.2f", "value")]
    seen = F.contains(F.col("_runs"), forms[0]) | F.contains(F.col("_runs"), forms[1]) | F.contains(F.col("_runs"), forms[2])
    reason = F.when(F.col("_runs").isNull(), "no text").otherwise("not in text")
    return j.where(F.col("_runs").isNull() | ~seen).withColumn("reason", reason).drop("_runs")


def unsupported_counts(findings: DataFrame, texts: DataFrame) -> DataFrame:
    without = F.col("reason") == "no text"
    return unsupported_values(findings, texts).groupBy("report_id").agg(F.count_if(~without).alias("unsupported"), F.count_if(without).alias("no_text"))


# --- chat -------------------------------------------------------------------
def context_retention(turns: DataFrame) -> DataFrame:
    """Share of turns whose reply contains one of the required keywords."""
    reply = F.lower("reply")
    passed = F.exists("keywords", lambda k: F.contains(reply, F.lower(k)))
    return turns.groupBy("conv_id").agg(
        F.count_if(passed).alias("retained"), n_rows().alias("turns"), (F.count_if(passed) / n_rows() * 100).alias("score")
    )


# --- telemetry --------------------------------------------------------------
def daily_metrics(metrics: DataFrame) -> DataFrame:
    day = F.to_date("created_at").alias("day")
    out = metrics.groupBy("metric_name", day).agg(n_rows().alias("events"), F.avg("value").alias("value"))
    return out.withColumn("grade", st.metric_status(F.col("metric_name"), F.col("value")))


def seven_day_means(daily: DataFrame) -> DataFrame:
    """Trailing seven-day mean of daily values (days are few per metric)."""
    w = Window.partitionBy("metric_name").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.withColumn("seven_day_mean", F.avg("value").over(w))


def exact_percentile(rows: DataFrame, key: str, value: str, share: float, near: float = 0.001) -> DataFrame:
    """(key, p): the interpolated percentile of each key, exactly.

    An approximate percentile on either side brackets it; values below the
    bracket are counted and only those inside are ranked, so a key with most of
    the rows sends its counts and a few thousandths of its values."""
    rows = rows.where(F.col(value).isNotNull())
    bounds = rows.groupBy(key).agg(
        n_rows().alias("_n"), F.percentile_approx(value, [max(0.0, share - near), min(1.0, share + near)], 10_000).alias("_q")
    ).select(F.col(key).alias("_key"), "_n", F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
    met = rows.join(bounds, F.col(key).eqNullSafe(F.col("_key")))
    # values under the bracket are one line, of which the largest may be needed; those inside have a line each
    lines = met.where(F.col(value) <= F.col("_b")).withColumn("_v", F.when(F.col(value) >= F.col("_a"), F.col(value)))
    counted = lines.groupBy(key, "_n", "_v").agg(n_rows().alias("_c"), F.max(value).alias("_m"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_to", upto)
    at = (F.col("_n") - 1) * F.lit(share)
    reach = lambda rank: F.min(F.when(F.col("_to") > rank, F.col("_m")))
    ends = ranked.groupBy(key, "_n").agg(reach(F.floor(at)).alias("_lo"), reach(F.ceil(at)).alias("_hi"))
    return ends.select(key, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))).alias("p"))


def metric_cards(metrics: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Card figures over the last days: counts, mean, latest value, latency."""
    recent = metrics.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    cards = recent.groupBy("metric_name").agg(
        n_rows().alias("events"), F.avg("value").alias("mean_value"), F.max_by("value", F.struct("created_at", "id")).alias("current_value"),
        F.count_if(F.col("value") > 0).alias("valid"),
    )
    return cards.join(exact_percentile(recent, "metric_name", "value", 0.95).withColumnRenamed("p", "p95"), "metric_name", "left")


def last_events(metrics: DataFrame, k: int = 100) -> DataFrame:
    """Sum over the last k events per metric; ranks are cut before the shuffle."""
    w = Window.partitionBy("metric_name").orderBy(F.desc("created_at"), F.desc("id"))
    last = metrics.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return last.groupBy("metric_name").agg(n_rows().alias("last_events"), F.sum("value").alias("last_sum"))


def token_usage(metrics: DataFrame) -> DataFrame:
    day = F.to_date("created_at").alias("day")
    return metrics.groupBy(day).agg(F.sum(F.get_json_object("metadata", "$.k").cast("long")).alias("input_tokens"), n_rows().alias("calls"))


def failed_files(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("metric_name") == "pdf_processing_success") & (F.col("value") < 90)).select(
        "id", F.get_json_object("metadata", "$.k").alias("findings"), "value", "created_at"
    )


def ingest_outcome(files: DataFrame) -> DataFrame:
    """Outcome of each batch: counts, remaining time, first five failures."""
    failed = ~F.col("ok")
    text = F.concat(F.col("file"), F.lit(": "), F.col("reason"))
    w = Window.partitionBy("batch_id").orderBy("pos")
    first5 = (
        files.where(failed).withColumn("_rn", F.row_number().over(w)).where("_rn <= 5").groupBy("batch_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", text.alias("t")))), lambda s: s["t"]), "; ").alias("details"))
    )
    out = files.groupBy("batch_id").agg(
        n_rows().alias("processed"), F.count_if(failed).alias("failed"), F.max("total").alias("total"), F.sum("seconds").alias("elapsed"),
        F.bool_and(F.when(failed, tx.is_rate_limit_reason(text))).alias("all_rate_limited"),
    )
    eta = F.floor(F.col("elapsed") / F.col("processed") * F.greatest(F.col("total") - F.col("processed"), F.lit(0))).cast("bigint")
    return out.join(first5, "batch_id", "left").select(
        "batch_id", "processed", "failed", "total", eta.alias("eta_seconds"),
        F.coalesce("details", F.lit("")).alias("details"),
        ((F.col("failed") > 0) & F.coalesce("all_rate_limited", F.lit(False))).alias("all_rate_limited"),
    )
