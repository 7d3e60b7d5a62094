"""Large blocks compared in shares of their signature keys, by rows that carry what their test reads."""

import random

import pytest
from test_dedupe import SCHEMA, greedy, random_rows

from factloom.operators import dedupe
from factloom.operators.dedupe import leader_clusters


@pytest.mark.parametrize("share_rows", [300, 2_000_000])
def test_shares_equal_the_greedy_order(spark, monkeypatch, share_rows):
    monkeypatch.setattr(dedupe, "SHARE_ROWS", share_rows)
    rows = random_rows(11, 150)
    got = leader_clusters(spark.createDataFrame(rows, SCHEMA), block_limit=1).collect()
    assert {(r.doc_id, r.seq): r.leader for r in got} == greedy(rows)


def test_signatures_carry_one_text_and_no_word_of_a_single_span(spark):
    rng = random.Random(3)
    rows = [("d", "co", i, " ".join([f"own{i}", *(rng.choice("abcdefgh") for _ in range(6))])) for i in range(40)]
    spans = spark.createDataFrame(rows, "doc_id string, subject_key string, seq long, span string")
    for side in dedupe._signatures(spans.withColumn("tokens", dedupe.token_set(spans.span))):
        assert side.where("(span is null) = (tokens is null)").count() == 0
        assert side.where("key rlike '^[tp]own'").count() == 0 and side.count() > 0
