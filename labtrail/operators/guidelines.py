"""Guideline retrieval: a table of questions against a table of knowledge.

A guideline scores by the terms (test names, keywords, related tests) that a
question and the active findings share with it:

* *terms in a text*: one multi-pattern automaton over all distinct terms reads
  each distinct text once, however many terms there are;
* *a text in terms* (a finding or word that is part of a term): an equi join
  with the written table of all parts of all terms.

Every hit is a row with its points, its term and its reason; a guideline's hits
for one kind of question (equal text and findings) are summed, and the kinds are
joined back to their questions.  Guidelines that reach the least score by
evidence, age and intent alone come from a join on the question's intents.

The knowledge table is a dimension: its terms go to every task, so their number
is checked against ``MOST_TERMS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labtrail import fixed_values as fv
from labtrail.functions import text as tx
from labtrail.functions import values as va
from labtrail.functions.basic import contains_any
from labtrail.session import materialize

KNOWLEDGE = (
    "ord int, id string, category string, names array<string>, aliases array<string>, keywords array<string>, related array<string>, "
    "source string, url string, title string, content string, trend_signals array<string>, escalation_triggers array<string>, "
    "actions array<string>, level string, updated string"
)
SHOWN = ["id", "category", "source", "url", "title", "content", "level"]
MOST_TERMS = 1_000_000
#: A guideline of so many points is taken even if its category has one already.
STRONG = 30
# fixed values: points and reasons, in the order in which hits are told
EXACT, PARTIAL, RELATED, ALIAS, KEYWORD, TOKEN = 28, 18, 9, 20, 8, 3
REASONS = {
    "exact": "exact active finding match", "partial": "partial active finding match", "related": "related test proximity",
    "alias": "query includes canonical test alias", "keyword": "query keyword match",
}
INTENTS = {"trend": ("trend_signals", 5, "trend intent alignment"), "urgency": ("escalation_triggers", 5, "urgency intent alignment"), "action": ("actions", 4, "action intent alignment")}


def knowledge(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The knowledge table: JSON lines at ``path``, or the built-in entries.

    A list of signals, triggers or actions that is null counts as given, an
    empty one as none.  ``ord`` decides between equal scores."""
    if path is not None:
        return spark.read.schema(KNOWLEDGE).json(path)
    fields = [f.split()[0] for f in KNOWLEDGE.split(", ")]
    return spark.createDataFrame([tuple(i if f == "ord" else e.get(f) for f in fields) for i, e in enumerate(fv.GUIDELINES)], KNOWLEDGE)


def terms(kb: DataFrame) -> DataFrame:
    """(ord, kind, pos, term): the entries' normalized terms; ``kind`` is name, keyword or related."""
    lists = {"name": F.concat(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>"))), "keyword": F.col("keywords"), "related": F.col("related")}
    rows = [kb.select("ord", F.lit(kind).alias("kind"), F.posexplode(c).alias("pos", "raw")) for kind, c in lists.items()]
    return reduce(DataFrame.unionByName, rows).select("ord", "kind", "pos", tx.query_text(F.col("raw")).alias("term")).where("term <> ''")


def parts(rows: DataFrame) -> DataFrame:
    """(part, term): every part of every distinct term."""
    t = F.col("term")
    cut = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.transform(F.sequence(F.lit(1), F.length(t) - i + 1), lambda n: t.substr(i, n)))
    return rows.select("term").distinct().select("term", F.explode(F.array_distinct(F.flatten(cut))).alias("part"))


def term_hits(texts: DataFrame, words: list[str]) -> DataFrame:
    """(text, term) of the distinct ``text`` values that hold one of ``words``: one pass of an automaton over each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for batch in batches:
            hits = [(t, w) for t in batch.column(0).to_pylist() for w in sorted({w for _, w in machine.iter(t)})] if words else []
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.string()), pa.array([w for _, w in hits], pa.string())], names=["text", "term"])

    return texts.select("text").distinct().where("text <> ''").mapInArrow(search, "text string, term string")


def _kind() -> Column:
    """The key of a kind of question: its text and findings."""
    return F.sha2(F.to_json(F.struct("query", "findings")), 256)


def _intent(kind: str) -> Column:
    return contains_any(F.col("q"), fv.INTENT_TERMS[kind])


def _hit(phase: int, points: Column | int, term: str | None, reason: Column | None, *order: Column | int) -> list[Column]:
    places = [o if isinstance(o, Column) else F.lit(o) for o in (*order, 0, 0, 0)[:3]]
    told = F.struct(F.lit(phase).alias("phase"), *[p.cast("int").alias(f"o{k}") for k, p in enumerate(places)], F.col(term).alias("term"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"))
    return [F.col("kind_id"), F.col("ord"), (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points"), told.alias("told")]


def scored_kinds(kinds: DataFrame, kb: DataFrame, as_of: Column, min_score: int = 15) -> DataFrame:
    """(kind_id, ord, score, told): guidelines of at least ``min_score`` for each kind (kind_id, query, findings)."""
    entries = terms(kb).withColumnRenamed("kind", "of")
    entries = materialize(entries, "guideline-terms")
    words = [r.term for r in entries.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(words) > MOST_TERMS:
        raise ValueError(f"a knowledge table may have {MOST_TERMS} distinct terms")
    pieces = materialize(parts(entries), "guideline-term-parts")

    prepared = kinds.select("kind_id", tx.query_text(F.coalesce("query", F.lit(""))).alias("q"), F.coalesce(F.transform("findings", tx.query_text), F.array().cast("array<string>")).alias("f"))
    prepared = materialize(prepared, "question-kinds")
    asked = prepared.select("kind_id", F.col("q").alias("text"))
    found = prepared.select("kind_id", F.posexplode("f").alias("fi", "text")).where("text <> ''")
    tokens = F.array_distinct(F.transform(tx.expanded_tokens(tx.query_tokens(F.col("q"))), tx.query_text))
    tokens = prepared.select("kind_id", F.posexplode(tokens).alias("ti", "token")).where(F.length("token") >= 2)

    hits = materialize(term_hits(asked.select("text").unionByName(found.select("text")), words), "guideline-term-hits")
    shared = hits.unionByName(found.select("text").distinct().join(pieces.withColumnRenamed("part", "text"), "text").where("text <> term").select("text", "term")).distinct()
    near = found.join(shared, "text").join(entries.where("of <> 'keyword'"), "term")
    same, related = F.col("text") == F.col("term"), F.col("of") == "related"
    points = F.when(related, RELATED).when(same, EXACT).otherwise(PARTIAL)
    reason = F.when(related, REASONS["related"]).when(same, REASONS["exact"]).otherwise(REASONS["partial"])
    told = asked.join(hits, "text").join(entries.where("of <> 'related'"), "term")
    alias = F.col("of") == "name"
    in_query = F.when(alias, REASONS["alias"]).otherwise(REASONS["keyword"])
    by_token = tokens.join(pieces, tokens.token == pieces.part).join(entries.where("of <> 'related'"), "term").select("kind_id", "ord", "ti", "token").distinct()
    rows = near.select(*_hit(0, points, "term", reason, F.col("fi"), related.cast("int"), F.col("pos")))
    rows = rows.unionByName(told.select(*_hit(1, F.when(alias, ALIAS).otherwise(KEYWORD), "term", in_query, (~alias).cast("int"), F.col("pos"))))
    rows = rows.unionByName(by_token.select(*_hit(2, TOKEN, "token", None, F.col("ti"))))
    summed = rows.groupBy("kind_id", "ord").agg(F.sum("points").alias("points"), F.array_sort(F.collect_list("told")).alias("told"))

    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(True))
    base = F.when(F.col("level") == "A", 2).when(F.col("level") == "B", 1).otherwise(0) + va.recency_score(F.col("updated"), as_of)
    facts = kb.select("ord", base.alias("base"), *[given(F.col(c)).alias(f"has_{i}") for i, (c, _, _) in INTENTS.items()])
    flags = prepared.select("kind_id", *[_intent(i).alias(i) for i in INTENTS])
    intents = sum((F.when(F.col(i) & F.col(f"has_{i}"), p).otherwise(0) for i, (_, p, _) in INTENTS.items()), F.lit(0))
    # entries that reach the score by their base and intents: listed for each set of intents
    sets = reduce(lambda df, i: df.withColumn(i, F.explode(F.array(F.lit(True), F.lit(False)))), INTENTS, facts)
    reach = flags.join(sets.where(F.col("base") + intents >= min_score).select(*INTENTS, "ord"), list(INTENTS)).select("kind_id", "ord")
    none = F.array().cast(summed.schema["told"].dataType)
    every = summed.unionByName(reach.select("kind_id", "ord", F.lit(0).cast("long").alias("points"), none.alias("told")))
    every = every.groupBy("kind_id", "ord").agg(F.sum("points").alias("points"), F.max_by("told", F.size("told")).alias("told"))
    scored = every.join(flags, "kind_id").join(facts, "ord").withColumn("score", (F.col("points") + F.col("base") + intents).cast("int")).where(F.col("score") >= min_score)
    aligned = F.filter(F.array(*[F.when(F.col(i) & F.col(f"has_{i}"), r) for i, (_, _, r) in INTENTS.items()]), lambda r: r.isNotNull())
    reasons = F.concat(F.filter(F.transform("told", lambda t: t.reason), lambda r: r.isNotNull()), aligned)
    return scored.select("kind_id", "ord", "score", F.array_distinct(F.transform("told", lambda t: t.term)).alias("matched_terms"), reasons.alias("rationale"))


def diverse_top(scored: DataFrame, keys: list[str], k: int = 3, strong: int = STRONG) -> DataFrame:
    """The best ``k`` rows of each key, with ``rank``: the first of each category, and all of at least ``strong`` points."""
    order = [F.desc("score"), F.asc("ord")]
    first = F.row_number().over(Window.partitionBy(*keys, "category").orderBy(*order))
    kept = scored.withColumn("_nth", first).where((F.col("score") >= strong) | (F.col("_nth") == 1)).drop("_nth")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _of_kinds(questions: DataFrame, answer) -> DataFrame:
    """``answer`` for each distinct (query, findings), joined to its questions."""
    asked = questions.withColumn("kind_id", _kind())
    found = materialize(answer(asked.groupBy("kind_id").agg(F.any_value("query").alias("query"), F.any_value("findings").alias("findings"))), "kind-answers")
    return asked.select("question_id", "kind_id").join(found, "kind_id").drop("kind_id")


def all_scores(questions: DataFrame, kb: DataFrame, as_of: Column, min_score: int = 15) -> DataFrame:
    """Every guideline that reaches the least score, per question: id, score, and how many reasons of each kind it has."""
    def answer(kinds: DataFrame) -> DataFrame:
        n = lambda r: F.size(F.filter("rationale", lambda x: x == REASONS[r]))
        rows = scored_kinds(kinds, kb, as_of, min_score).withColumns({f"n_{r}": n(r) for r in REASONS})
        return rows.withColumn("n_terms", F.size("matched_terms")).drop("matched_terms", "rationale").join(kb.select("ord", "id", "category", "source", "url"), "ord")

    return _of_kinds(questions, answer)


def retrieve(questions: DataFrame, kb: DataFrame, as_of: Column, k: int = 3, min_score: int = 15) -> DataFrame:
    """The best guidelines per question, with what matched and why.

    ``questions``: (question_id, query, findings array<string>); the query is
    the message followed by recent history.  Null counts as empty."""
    def answer(kinds: DataFrame) -> DataFrame:
        rows = scored_kinds(kinds, kb, as_of, min_score).join(kb.select("ord", *SHOWN), "ord")
        return diverse_top(rows, ["kind_id"], k)

    return _of_kinds(questions, answer)


def guideline_section() -> Column:
    """One guideline as lines of a prompt."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    return F.concat(
        F.lit("["), F.col("source"), F.lit("]  [retrieval score: "), F.col("score").cast("string"), F.lit("]\n"), F.coalesce("title", F.col("id")),
        F.lit("\nCategory: "), F.col("category"), F.coalesce(F.concat(F.lit("\nCore content:\n"), F.col("content")), F.lit("")),
        F.lit("\nMatched retrieval terms: "), F.coalesce(listed(F.col("matched_terms")), F.lit("none")),
        F.lit("\nRetrieval rationale: "), F.coalesce(listed(F.col("rationale")), F.lit("semantic overlap")),
        F.lit("\nEvidence level: "), F.col("level"), F.lit('\nCite as: "'), F.col("source"), F.lit('" - '), F.col("url"),
    )
