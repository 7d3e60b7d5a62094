"""Batches of questions answered from the nearest facts, with resolved citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.responses import json_object
from factloom.operators.nearest import nearest_join
from factloom.operators.requests import ask_cached, request_key
from factloom.session import materialize

TOP_K = 8
# The two answers given without a usable reply.
REFUSAL = "Not enough grounded evidence."
UNREADABLE = "Unable to generate a grounded answer (LLM response parse error)."
SYSTEM = (
    "Answer the question from the given facts only. Reply with a JSON object with the keys answer "
    "(a short text) and cited_fact_ids (the ids of the facts you used)."
)
FACT_COLUMNS = ["id", "doc_id", "page", "subject", "attribute", "value", "unit", "temporal_context", "evidence_span", "claim_text"]


def retrieve(questions: DataFrame, facts: DataFrame, top_k: int = TOP_K, **options) -> DataFrame:
    """``question_id, rank, distance`` and the fact columns of the nearest facts."""
    found = nearest_join(questions, facts, top_k, query_id="question_id", **options)
    wide = facts.select(F.col("id").alias("base_id"), F.struct(*FACT_COLUMNS).alias("fact"))
    return found.withColumnRenamed("query_id", "question_id").join(wide, "base_id").drop("base_id")


def context_line(fact: Column) -> Column:
    return F.concat(
        F.lit("["), fact.id, F.lit("] "), fact.subject, F.lit(" / "), fact.attribute, F.lit(" = "),
        F.trim(F.concat_ws(" ", fact.value, fact.unit)), F.lit(" / "), fact.temporal_context,
        F.lit(' / "'), fact.evidence_span, F.lit('"'),
    )


def contexts(retrieved: DataFrame) -> DataFrame:
    """One row per question: its fact lines in rank order (at most top-k of them)."""
    line = F.struct("rank", context_line(F.col("fact")).alias("line"))
    lines = F.sort_array(F.collect_list(line))
    return retrieved.groupBy("question_id").agg(F.array_join(lines.line, "\n").alias("context"))


def _answers(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """Left join of replies; questions without facts get the refusal."""
    return questions.select("question_id", "question").join(replies, "question_id", "left")


def extractive_answers(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Default responder: the claim of the nearest fact, which is its one citation."""
    top = retrieved.where(F.col("rank") == 1).select(
        "question_id", F.col("fact.claim_text").alias("answer"), F.array(F.col("fact.id")).alias("cited")
    )
    return _answers(questions, top).select(
        "question_id",
        "question",
        F.coalesce("answer", F.lit(REFUSAL)).alias("answer"),
        F.coalesce("cited", F.expr("cast(array() as array<string>)")).alias("cited"),
    )


def model_answers(
    questions: DataFrame,
    retrieved: DataFrame,
    complete: Callable[[str, str], str],
    *,
    concurrency: int | None = None,
    cache: DataFrame | None = None,
    model: str = "model",
) -> tuple[DataFrame, DataFrame]:
    """(answers by the caller's model, new cache rows); questions without facts are refused without asking it."""
    prompts = questions.join(contexts(retrieved), "question_id").select(
        "question_id",
        F.lit(SYSTEM).alias("system"),
        F.concat(F.lit("Question: "), "question", F.lit("\n\nFacts:\n"), "context").alias("user"),
    )
    prompts = prompts.withColumn("key", request_key(model, F.col("system"), F.col("user")))
    answers, fresh = ask_cached(prompts, complete, cache, concurrency)
    reply = json_object(F.col("response"))
    replies = prompts.select("key", "question_id").join(answers, "key").withColumn("reply", reply)
    empty = F.expr("cast(array() as array<string>)")
    said = F.coalesce(F.try_variant_get("reply", "$.answer", "string"), F.lit(""))
    read = replies.select(
        "question_id",
        F.when(F.col("reply").isNull(), UNREADABLE).otherwise(said).alias("answer"),
        F.coalesce(F.try_variant_get("reply", "$.cited_fact_ids", "array<string>"), empty).alias("cited"),
    )
    found = _answers(questions, read).select(
        "question_id", "question", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"),
        F.coalesce("cited", empty).alias("cited"),
    )
    return found, fresh


def citations(answers: DataFrame, retrieved: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Cited facts in the order cited; unknown ids are dropped.

    Only facts retrieved for the question can be cited; with ``facts`` any stored fact can.
    """
    cited = answers.select("question_id", F.posexplode("cited").alias("position", "fact_id"))
    columns = ["fact_id", "doc_id", "page", "evidence_span"]
    if facts is not None:
        known = facts.withColumnRenamed("id", "fact_id").select(*columns)
        return cited.join(known, "fact_id").select("question_id", "position", *columns)
    known = retrieved.select(
        "question_id", F.col("fact.id").alias("fact_id"), "fact.doc_id", "fact.page", "fact.evidence_span"
    )
    return cited.join(known, ["question_id", "fact_id"]).select("question_id", "position", *columns)


def answer(
    questions: DataFrame, facts: DataFrame, complete: Callable[[str, str], str] | None = None,
    top_k: int = TOP_K, **options,
) -> tuple[DataFrame, DataFrame]:
    """(answers, citations) for ``question_id, question, embedding`` rows; one question is one row."""
    retrieved = materialize(retrieve(questions, facts, top_k, **options), "retrieved")
    if complete is None:
        answers = extractive_answers(questions, retrieved)
    else:
        answers, _ = model_answers(questions, retrieved, complete)
    return answers.drop("cited"), citations(answers, retrieved)
