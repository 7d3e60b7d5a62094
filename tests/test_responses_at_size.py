"""Brackets are found from the signs that count; rows of a response are read once; records need no join."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from factloom.functions.responses import closing_bracket


def _closing(text: str) -> int:
    depth, quoted, escaped = 0, False, False
    for at, c in enumerate(text, 1):
        if not quoted and c in "[]":
            depth += 1 if c == "[" else -1
            if c == "]" and depth == 0:
                return at
        was = escaped
        escaped = quoted and c == "\\" and not was
        if c == '"' and not was:
            quoted = not quoted
    return 0


def test_closing_brackets_as_by_characters(spark):
    rng = random.Random(5)
    texts = ["[" + "".join(rng.choice('[]"\\ab\n\u00e9\U0001f600') for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["[" + json.dumps(['a "quoted" [part]', "back\\slash", "\\"]) + "] and [more]", "[", "[]", '["\\\\"]', '["\\"]"]', '["\\a\\"]"]']
    rows = spark.createDataFrame([(t, _closing(t)) for t in texts], "text string, at int").repartition(8)
    assert rows.where(closing_bracket(F.col("text")) != F.col("at")).count() == 0


def test_a_fold_takes_no_step_for_an_ordinary_character(spark):
    text = spark.range(1).select(F.concat(F.lit("["), F.repeat(F.lit("x"), 300_000), F.lit("]")).alias("t"))
    plan = text.select(closing_bracket(F.col("t")).alias("at"))
    assert plan.first().at == 300_002
    assert "split(t#" in plan._jdf.queryExecution().analyzed().toString() and ", , -1)" not in plan._jdf.queryExecution().analyzed().toString()


def test_queries_read_rows_once_and_join_no_records(spark):
    from factloom.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan("record_round_trip")
    assert plan("response_row_counts").count("Project") >= 2
