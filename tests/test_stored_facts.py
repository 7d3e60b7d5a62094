"""Stored facts are the claims, written once and read past what is dropped; documents come from one list a customer."""

from __future__ import annotations

from factloom.plans.build import build_facts, stored_facts
from factloom.session import scratch_dir


def _documents(spark, repeated: bool):
    texts = []
    for n in range(6):
        lines = [f"Customer {n} revenue was {100 + n}.{y} thousand USD in CY{1990 + y}." for y in range(4)]
        if repeated:
            lines.append(lines[0] + " ")
        texts.append((f"d{n}", "\n".join(lines), n))
    return spark.createDataFrame(texts, "doc_id string, text string, ingest_seq long")


def _files_of(df):
    return {name.rsplit("/", 2)[-2].rsplit("-", 1)[0] for name in df.inputFiles()}


def test_facts_are_the_written_claims_and_do_not_move(spark):
    for repeated in (False, True):
        docs = _documents(spark, repeated)
        facts = stored_facts(docs)
        assert sorted(facts.collect()) == sorted(build_facts(docs).collect())
        assert facts.count() == 24
        assert "claims" in _files_of(facts) and "facts" not in _files_of(facts)
        plan = facts._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert scratch_dir(spark)


def test_many_dropped_claims_are_written_out_of_the_facts(spark, monkeypatch):
    from factloom.operators import dedupe

    monkeypatch.setattr(dedupe, "BROADCAST_DROPPED", 1)
    docs = _documents(spark, True)
    facts = stored_facts(docs)
    assert _files_of(facts) == {"facts"}
    assert sorted(facts.collect()) == sorted(build_facts(docs).collect())


def test_similar_sets_at_four_fifths(spark):
    from pyspark.sql import functions as F

    from factloom.functions.text import sets_similar

    rows = [(list("abcd"), list("abcde"), True), (list("abcdefgh"), list("abcdefghxy"), True), (list("abcdefg"), list("abcdefxy"), False), ([], [], True), (list("abcdefghi"), list("abcdefghj"), True), (list("abcd"), list("abce"), False)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, same boolean")
    assert df.where(sets_similar(F.col("a"), F.col("b")) != F.col("same")).count() == 0
