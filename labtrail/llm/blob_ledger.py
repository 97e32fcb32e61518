"""Secret scans with an incremental ledger of blobs.  DataFrame functions only.

Every version of a file (a row of ``history``) is named by the SHA-256 of its
text, its *blob*.  The ledger is a table that says, for each blob, which rules
(by kind and version) have read it and what they found: offsets, never the
secret.  A scan

1. writes the paths, ``(doc_id, blob, copies)``, and lists their blobs;
2. drops every pair of blob and rule that the ledger has;
3. reads each remaining blob once, by the rules it still lacks, and appends
   rules and findings to the ledger in one write (a lost job appends nothing);
4. joins the findings of the present rules back to all paths.

A new version of a rule has a new name, so it reads all blobs, and findings of
the old version no longer count.

Shuffles: paths by blob (narrow); one text a blob and task, which Spark reduces
to the unseen blobs before the shuffle where few are left (a semi join with the
written list of them); findings.  Blobs of over a thousandth of all paths are
salted by doc_id when findings meet paths; there are at most a thousand.

Offsets come from a running sum over the stretches between and in matches, so a
text of many matches costs time in proportion.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labtrail.llm.common import materialize
from labtrail.session import scratch_path


class Rule(NamedTuple):
    """A match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the base rules, then those that this scan adds
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # a run too short to count holds no longer one, so the least length can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,512}\.eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,512}"),
    Rule("url", 1, r"[a-z]{2,12}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)

LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:long,end:long>>"
SALTS = 64
#: A blob of more than one path in so many is salted.
HOT_SHARE = 1000


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none while there is no ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _blob() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def pending_pairs(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules): the rules that have not read a blob yet; blobs that all have read are left out."""
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("rules")).where(F.size("rules") > 0)


def find(bodies: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``bodies`` (blob, rules, text), each blob once: leftmost matches that don't overlap, by rule."""

    def stretches(rule: Rule) -> Column:
        gaps = F.transform(F.split("text", rule.pattern, -1), lambda g: F.length(g))
        found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        # the stretch after the last match has none
        pieces = F.transform(found, lambda m, k: F.struct(F.get(gaps, k).alias("gap"), m.alias("match")))
        wanted = F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern)
        return F.when(wanted, F.struct(F.lit(rule.key).alias("rule"), pieces.alias("pieces")))

    hits = bodies.select("blob", "rules", F.array_compact(F.array(*map(stretches, rules))).alias("hits"))
    by_rule = hits.select("blob", "rules", F.explode_outer("hits").alias("hit"))
    pieces = by_rule.select("blob", "rules", "hit.rule", F.posexplode_outer("hit.pieces").alias("k", "piece"))
    so_far = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = pieces.withColumn("end", F.sum((F.col("piece.gap") + F.length("piece.match")).cast("long")).over(so_far))
    counts = reduce(
        lambda other, r: F.when(F.col("rule") == r.key, F.length(F.regexp_extract("piece.match", r.pattern, r.group)) >= r.least).otherwise(other),
        rules, F.lit(False),
    )
    finding = F.struct("rule", (F.col("end") - F.length("piece.match")).alias("start"), "end")
    return ended.groupBy("blob").agg(F.any_value("rules").alias("rules"), F.collect_list(F.when(counts, finding)).alias("findings"))


def scan(history: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``history``: doc_id, its blob, and ``findings`` of the rules by start, then in the rules' order.

    ``history`` needs ``doc_id`` (the path or version) and ``text``; other
    columns are ignored.  ``ledger`` is the table's folder, which the call
    appends to; without one a new folder under ``spark.checkpoint.dir`` is
    used.  A null text is empty and has no findings; a null doc_id is kept;
    repeated rows give repeated rows; an empty table gives none.  Where two
    rules find the same place, both findings stand.
    """
    spark = history.sparkSession
    ledger = ledger or scratch_path(spark, "blob-ledger")
    paths = materialize(history.select("doc_id", _blob().alias("blob")).groupBy("doc_id", "blob").agg(F.count("*").alias("copies")), "blob-paths")
    blobs = paths.groupBy("blob").agg(F.count("*").alias("paths"))
    pending = materialize(pending_pairs(blobs, read_ledger(spark, ledger), rules), "pending-blobs")
    texts = history.select(_blob().alias("blob"), "text").groupBy("blob").agg(F.any_value("text").alias("text"))
    # a semi join with few blobs goes below the aggregate, before the shuffle
    unseen = texts.join(pending.select("blob"), "blob", "left_semi").join(pending, "blob")
    find(unseen, rules).write.mode("append").parquet(ledger)

    kinds = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    known = read_ledger(spark, ledger).join(blobs.select("blob"), "blob", "left_semi").select("blob", F.inline("findings"))
    known = known.where(F.col("rule").isin([r.key for r in rules])).select("blob", F.struct("start", kinds[F.col("rule")].alias("order"), "end").alias("f"))
    # a set: two scans at the same time may both have read a blob
    found = known.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("found"))

    total = F.broadcast(paths.agg(F.count("*").alias("all")))
    hot = materialize(blobs.join(total, F.col("paths") * HOT_SHARE > F.col("all")).where(F.col("paths") > SALTS).select("blob", F.lit(True).alias("hot")), "hot-blobs")
    salted = paths.join(F.broadcast(hot), "blob", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    found = found.join(F.broadcast(hot), "blob", "left").select("blob", spread.alias("salt"), "found")
    kind = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform("found", lambda f: F.struct(F.get(kind, f.order).alias("kind"), f.start.alias("start"), f.end.alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    met = salted.join(found, ["blob", "salt"], "left").select("doc_id", "blob", "copies", F.coalesce(named, none).alias("findings"))
    return met.select("doc_id", "blob", "findings", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digest of the base rules, and all spans as text, of the rows of ``scan``."""
    base = [r.kind for r in rules if r.base]
    shown = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
    of = lambda kinds: F.filter("findings", lambda f: f.kind.isin(kinds))
    own = of(base)
    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(shown(own), 256).alias("base_sha256"), shown(F.col("findings")).alias("spans"),
        (F.size("findings") - F.size(own)).cast("long").alias("n_added"), "blob",
    )
