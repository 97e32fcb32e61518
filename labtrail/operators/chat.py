"""What an assistant is told before it answers a patient: the patient's record and the guidelines that fit the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.operators import guidelines as gl
from labtrail.operators import timelines as tl
from labtrail.operators.resolve import SCOPE

#: Turns before a question that are searched with it, and findings that count as active.
HISTORY, ACTIVE = 6, 10


def chat_questions(turns: DataFrame, history: int = HISTORY) -> DataFrame:
    """(question_id, scope, turn, message, history): each turn of a user, with the contents of the last turns before it.

    ``turns`` needs the scope, conv_id, turn, role and text; null texts are empty.
    """
    told = turns.select(SCOPE, "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-history, -1)
    asked = told.withColumn("history", F.collect_list("text").over(before)).where("role = 'user'")
    return asked.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), SCOPE, "turn", F.col("text").alias("message"), "history")


def active_findings(findings: DataFrame, k: int = ACTIVE) -> DataFrame:
    """(scope, findings): the names of the newest ``k`` findings, newest first."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda x: x["canonical"])
    return tl.snapshot(findings, k).groupBy(SCOPE).agg(names.alias("findings"))


def chat_context(findings: DataFrame, turns: DataFrame, kb: DataFrame, as_of: Column) -> DataFrame:
    """One row per question of a patient with findings: the message, its history, the prompt's parts and the guidelines' section.

    Findings of patients without a question are left out before they are grouped."""
    asking = turns.where("role = 'user'").select(SCOPE).distinct()
    findings = findings.join(asking, SCOPE, "left_semi")
    asked = chat_questions(turns).join(active_findings(findings), SCOPE)
    queries = asked.select("question_id", F.concat_ws(" ", "message", F.array_join("history", " ")).alias("query"), "findings")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n")
    found = gl.retrieve(queries, kb, as_of).select("question_id", "rank", gl.guideline_section().alias("line"))
    sections = found.groupBy("question_id").agg(F.count("*").alias("n_guidelines"), lines.alias("guidelines"))
    return asked.drop("findings").join(tl.prompt_parts(findings), SCOPE).join(sections, "question_id", "left").withColumns({
        "n_guidelines": F.coalesce("n_guidelines", F.lit(0)), "guidelines": F.coalesce("guidelines", F.lit("")),
    })
