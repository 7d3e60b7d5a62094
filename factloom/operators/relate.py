"""Relating facts across documents: candidates, rules or a model for each pair, edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.responses import adjudication
from factloom.functions.text import normal_span
from factloom.functions.vectors import token_embedding
from factloom.operators.nearest import nearest_join
from factloom.operators.requests import THREADS, ask_cached, asked_in_runs, request_key
from factloom.session import materialize

TOP_K = 8
VALUE_TOLERANCE = 0.005

SYSTEM = (
    "Classify how two claims relate. Only claims about the same attribute of the same subject can be "
    "corroborate (values agree), contradict (values exclude each other in the same context) or "
    "reconcilable (the difference comes from time, scope or unit); all others are unrelated. Answer "
    "with a JSON object with the keys relation, reasoning, reconciling_dimension (time, scope, unit "
    "or none) and confidence (0 to 1)."
)


def attribute_key(attribute: Column) -> Column:
    return F.lower(F.trim(attribute))


def candidate_pairs(
    facts: DataFrame,
    earlier_facts: DataFrame | None = None,
    top_k: int = TOP_K,
    *,
    match: list[str] | None = None,
    probes: int | None = None,
    **options,
) -> DataFrame:
    """``fact_a_id, fact_b_id, distance, rank``: nearest facts of other, earlier documents.

    ``facts`` need ``id, doc_id, ingest_seq, embedding``. As b was ingested before a, a pair comes
    up from one side only and needs no further de-duplication. ``match`` restricts candidates to
    equal columns, e.g. subject and attribute, outside of which no rule can relate two facts.
    """
    base = facts if earlier_facts is None else earlier_facts
    pairs = nearest_join(
        facts, base, top_k, match=match, differ="doc_id", earlier="ingest_seq", probes=probes, **options
    )
    return pairs.select(
        F.col("query_id").alias("fact_a_id"), F.col("base_id").alias("fact_b_id"), "distance", "rank"
    ).where(F.col("fact_a_id") != F.col("fact_b_id"))


def distinct_pairs(pairs: DataFrame, a: str = "fact_a_id", b: str = "fact_b_id") -> DataFrame:
    """Unordered pairs once, self pairs dropped."""
    low, high = F.least(a, b), F.greatest(a, b)
    return pairs.where(F.col(a) != F.col(b)).select(low.alias(a), high.alias(b)).distinct()


def with_facts(pairs: DataFrame, facts: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join both facts of each pair as structs ``a`` and ``b``."""
    for side in ("a", "b"):
        wide = facts.select(F.col("id").alias(f"fact_{side}_id"), F.struct(*columns).alias(side))
        pairs = pairs.join(wide, f"fact_{side}_id", how)
    return pairs


RULE_COLUMNS = [
    "id", "canonical_subject", "attribute", "value", "normalized_value", "normalized_unit",
    "period_start", "period_end", "scope_qualifiers", "confidence",
]


def rule_verdict() -> Column:
    """struct(relation, reconciling_dimension, reasoning) for structs ``a`` and ``b``, in this order:

    other subject or attribute: unrelated; other known period: reconcilable by time; values within
    0.5 %, same unit: corroborate; other unit: reconcilable by unit; other scope: reconcilable by
    scope; two numbers: contradict; two texts: corroborate when equal, else contradict; a number and
    a text: unrelated. Tolerance and order are choices of this package.
    """
    a, b = F.col("a"), F.col("b")

    def verdict(relation: str, dimension: str, reason: str) -> Column:
        return F.struct(
            F.lit(relation).alias("relation"),
            F.lit(dimension).alias("reconciling_dimension"),
            F.lit(reason).alias("reasoning"),
        )

    other_topic = ~(a.canonical_subject.eqNullSafe(b.canonical_subject)) | (
        attribute_key(a.attribute) != attribute_key(b.attribute)
    )
    other_period = (a.period_start != b.period_start) | (a.period_end != b.period_end)
    numbers = a.normalized_value.isNotNull().cast("int") + b.normalized_value.isNotNull().cast("int")
    same_unit = F.coalesce(a.normalized_unit, F.lit("")) == F.coalesce(b.normalized_unit, F.lit(""))
    gap = F.abs(a.normalized_value - b.normalized_value)
    largest = F.greatest(F.abs(a.normalized_value), F.abs(b.normalized_value))
    scope = lambda f: F.array_sort(f.scope_qualifiers)
    return (
        F.when(other_topic, verdict("unrelated", "none", "different subject or attribute"))
        .when(other_period, verdict("reconcilable", "time", "periods differ"))
        .when(
            (numbers == 2) & same_unit & (gap <= largest * VALUE_TOLERANCE),
            verdict("corroborate", "none", "values agree"),
        )
        .when(~same_unit, verdict("reconcilable", "unit", "units differ"))
        .when(scope(a) != scope(b), verdict("reconcilable", "scope", "scopes differ"))
        .when(numbers == 2, verdict("contradict", "none", "values differ"))
        .when(
            (numbers == 0) & (normal_span(a.value) == normal_span(b.value)),
            verdict("corroborate", "none", "values agree"),
        )
        .when(numbers == 0, verdict("contradict", "none", "values differ"))
        .otherwise(verdict("unrelated", "none", "a number and a text"))
    )


def edge_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws("\0", a, b), 256), 1, 32))


def adjudicate_by_rules(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """All judged pairs as edges, ``unrelated`` ones included; missing facts drop the pair."""
    return rule_edges(with_facts(pairs.select("fact_a_id", "fact_b_id"), facts, RULE_COLUMNS))


def rule_edges(described: DataFrame, *more: str) -> DataFrame:
    """Edges by rule of pairs that carry both facts as structs ``a`` and ``b``, and the columns ``more``."""
    return described.withColumn("v", rule_verdict()).select(
        edge_id(F.col("fact_a_id"), F.col("fact_b_id")).alias("id"),
        "fact_a_id",
        "fact_b_id",
        F.col("v.relation").alias("relation"),
        F.col("v.reasoning").alias("reasoning"),
        F.col("v.reconciling_dimension").alias("reconciling_dimension"),
        F.least("a.confidence", "b.confidence").alias("confidence"),
        *more,
    )


def informative(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation") != "unrelated")


PROMPT_COLUMNS = [
    "claim_text", "subject", "attribute", "value", "unit", "normalized_value", "normalized_unit",
    "temporal_context", "period_start", "period_end", "scope_qualifiers", "evidence_span",
]


def describe_fact(fact: Column, title: str) -> Column:
    """One fact as prompt lines; lines of unknown parts are left out."""
    joined = lambda *parts: F.trim(F.concat_ws(" ", *parts))
    period = F.concat(
        F.coalesce(fact.period_start, F.lit("?")), F.lit(" to "), F.coalesce(fact.period_end, F.lit("?"))
    )
    when_known = F.coalesce(F.nullif(fact.temporal_context, F.lit("")), F.lit("(none)"))
    return F.concat_ws(
        "\n",
        F.lit(title),
        F.concat(F.lit("claim: "), fact.claim_text),
        F.concat(F.lit("subject: "), fact.subject),
        F.concat(F.lit("attribute: "), fact.attribute),
        F.concat(F.lit("value: "), joined(fact.value, fact.unit)),
        F.when(
            fact.normalized_value.isNotNull(),
            F.concat(F.lit("normalised: "), joined(F.call_function("format_number", fact.normalized_value, F.lit("0.######")), fact.normalized_unit)),
        ),
        F.concat(F.lit("time: "), when_known),
        F.when(fact.period_start.isNotNull() | fact.period_end.isNotNull(), F.concat(F.lit("period: "), period)),
        F.when(F.size(fact.scope_qualifiers) > 0, F.concat(F.lit("scope: "), F.array_join(fact.scope_qualifiers, ", "))),
        F.concat(F.lit("evidence: "), fact.evidence_span),
    )


def pair_requests(pairs: DataFrame, facts: DataFrame, model: str = "model") -> DataFrame:
    return described_requests(with_facts(pairs.select("fact_a_id", "fact_b_id"), facts, PROMPT_COLUMNS), model)


def described_requests(described: DataFrame, model: str = "model", *more: str) -> DataFrame:
    """Requests of pairs that carry both facts as structs ``a`` and ``b``, and the columns ``more``."""
    user = F.concat_ws("\n\n", describe_fact(F.col("a"), "Claim A"), describe_fact(F.col("b"), "Claim B"))
    return described.select("fact_a_id", "fact_b_id", *more, F.lit(SYSTEM).alias("system"), user.alias("user")).withColumn(
        "key", request_key(model, F.col("system"), F.col("user"))
    )


def adjudicated(answers: DataFrame) -> DataFrame:
    """Edges from ``fact_a_id, fact_b_id, response``; unusable responses drop their pair only."""
    # As the one element of a list that is exploded, a verdict is read once, however often it is used and filtered.
    read = answers.select("fact_a_id", "fact_b_id", F.explode(F.array(adjudication(F.col("response")))).alias("v"))
    return read.where(F.col("v").isNotNull()).select(
        edge_id(F.col("fact_a_id"), F.col("fact_b_id")).alias("id"), "fact_a_id", "fact_b_id", "v.*"
    )


def adjudicate_by_model(
    pairs: DataFrame,
    facts: DataFrame,
    complete: Callable[[str, str], str],
    *,
    concurrency: int | None = None,
    threads: int = THREADS,
    cache: DataFrame | None = None,
    model: str = "model",
) -> tuple[DataFrame, DataFrame]:
    """(edges by the caller's model, new cache rows); a failing call loses its own pair and nothing else."""
    requests = pair_requests(pairs, facts, model)
    answers, fresh = ask_cached(requests, complete, cache, concurrency, threads)
    return adjudicated(requests.select("key", "fact_a_id", "fact_b_id").join(answers, "key")), fresh


def adjudicate_blocks(
    described: DataFrame, complete: Callable[[str, str], str], *, threads: int = THREADS, model: str = "model", keep: bool = True
) -> DataFrame:
    """Edges by the caller's model of pairs as ``related_facts`` describes them; see :func:`adjudicate_by_model`.

    Equal requests come from facts of one block, which lies in one run: they are asked there once and nothing is
    shuffled. Only requests of large blocks, which come in no order, meet by their key first. ``keep`` writes the
    answers, so that a model is not asked again when the edges are read again.
    """
    ready = described.where(F.col("block").isNotNull())
    user = described_requests(ready.select("fact_a_id", "fact_b_id", "a", "b", "block"), model, "block").select("block", "fact_a_id", "fact_b_id", "user")
    pair = ", ".join(f"{c} {described.schema[c].dataType.simpleString()}" for c in ("fact_a_id", "fact_b_id"))
    answers = user.mapInPandas(asked_in_runs(complete, SYSTEM, threads), f"{pair}, response string")
    edges = adjudicated(materialize(answers, "answers") if keep else answers)
    # Without large blocks no row can lack its block, and Spark knows: nothing is left to read.
    others = described_requests(described.where(F.col("block").isNull()), model)
    met, _ = ask_cached(others, complete, threads=threads)
    return edges.unionByName(adjudicated(others.select("key", "fact_a_id", "fact_b_id").join(met, "key")))


def embed_claims(facts: DataFrame, dim: int = 64) -> DataFrame:
    return facts.withColumn("embedding", token_embedding(F.col("claim_text"), dim))
