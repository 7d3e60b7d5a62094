"""Dropped near-duplicates are found from one shuffle; facts without any do not move."""

from pyspark.sql import functions as F

from factloom.functions.normalize import parse_period
from factloom.operators.dedupe import dedupe_facts, leader_clusters, survivors


def test_dropped_facts_are_those_outside_the_survivors(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("w"), (F.hash("id", i) % 3).cast("string")))
    facts = spark.range(240).select(
        F.concat(F.lit("d"), F.col("id") % 6).alias("doc_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 2 == 0, " Acme ").otherwise("acme").alias("subject"),
        F.array_join(words, " ").alias("evidence_span"), ((F.col("id") % 4) / 4).alias("confidence"),
    ).cache()
    kept = {(r.doc_id, r.seq) for r in survivors(leader_clusters(facts)).collect()}
    assert 6 < len(kept) < 240
    for limit in (1024, 8):
        assert {(r.doc_id, r.seq) for r in dedupe_facts(facts, block_limit=limit).collect()} == kept


def test_facts_without_duplicates_are_not_shuffled(spark):
    rows = [(f"d{i}", i, "s", f"text {i}", 0.5) for i in range(20)]
    plan = dedupe_facts(spark.createDataFrame(rows, "doc_id string, seq long, subject string, evidence_span string, confidence double"))
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_periods_without_a_fiscal_year_try_no_cast(spark):
    plan = spark.range(1).select(parse_period(F.concat(F.lit("CY"), F.col("id") + 1990)))
    assert "try_cast" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
