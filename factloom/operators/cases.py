"""Showcase: the best example of each relation with distinct facts, and the weakest fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.relate import with_facts
from factloom.schemas import FACT_FIELDS
from factloom.session import materialize

SLOTS = ["corroborate", "contradict", "reconcilable"]


def build_cases(facts: DataFrame, edges: DataFrame, complete: bool = False) -> DataFrame:
    """Rows ``slot, edge_id, fact_a_id, fact_b_id, relation, confidence`` (up to four).

    Per slot the most confident edge with both facts present, preferring edges that share no fact
    with an earlier slot, else the best one; ties by edge id. ``failure`` is the least confident
    fact, preferring unused ones. ``complete`` tells that both facts of every edge are known. Each slot is one top-1 sort; only its two ids come to the driver.
    """
    known = facts.select("id")
    for side in () if complete else ("fact_a_id", "fact_b_id"):
        edges = edges.join(known.withColumnRenamed("id", side), side, "left_semi")
    # Written once: every slot reads the complete edges.
    columns = ["id", "fact_a_id", "fact_b_id", "relation", "confidence"]
    complete = materialize(edges.where(F.col("relation").isin(SLOTS)).select(*columns), "complete-edges")
    used: list = []
    picked = []
    for slot in SLOTS:
        shares = (F.col("fact_a_id").isin(used) | F.col("fact_b_id").isin(used)) if used else F.lit(False)
        best = (
            complete.where(F.col("relation") == slot)
            .orderBy(shares.cast("int"), F.desc("confidence"), "id")
            .limit(1)
            .select(*columns)
            .first()
        )
        if best is not None:
            picked.append((slot, *best))
            used += [best.fact_a_id, best.fact_b_id]
    taken = F.col("id").isin(used) if used else F.lit(False)
    worst = facts.orderBy(taken.cast("int"), "confidence", "id").select("id", "confidence").first()
    if worst is not None:
        picked.append(("failure", None, worst.id, None, None, worst.confidence))
    schema = (
        "slot string, edge_id string, fact_a_id string, fact_b_id string, relation string, confidence double"
    )
    return facts.sparkSession.createDataFrame(picked, schema)


def case_details(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Cases with both facts as structs."""
    return with_facts(cases, facts, FACT_FIELDS, how="left")
