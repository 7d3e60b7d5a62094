import json
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions.responses import closing_bracket, json_rows
from factloom.operators.evaluate import containing, gold_report
from factloom.operators.nearest import lsh_join, nearest_join
from factloom.operators.requests import ask
from factloom.schemas import EDGES, FACTS
from factloom.sources.blocks import decode_numbered, html_blocks
from factloom.sources.records import export_csv, export_json, read_csv, read_json


def column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} string")


def test_numbered_characters(spark):
    cases = {
        "it&#8217;s &#x41;&#X42;": "it\u2019s A&#X42;", "&#128512;": "\U0001f600", "&#xD800;&#1114112;&#;&#9": "&#xD800;&#1114112;&#;&#9",
        "&#0;": "\ufffd", "plain": "plain", "a&#38;#39;": "a&#39;",
    }
    df = column(spark, list(cases))
    assert [r.d for r in df.select("id", decode_numbered(F.col("t")).alias("d")).orderBy("id").collect()] == list(cases.values())
    page = spark.createDataFrame([("p", "<p>&#8220;Q&#8221; &amp; A</p>")], "doc_id string, html string")
    assert html_blocks(page).first().text == "\u201cQ\u201d & A"


def test_brackets_are_matched_in_one_pass(spark):
    cases = {
        '[1, "]"] tail ]': 8, '["a\\"]", [2]] x': 13, "[[1]": 0, "[": 0, "[]": 2, '["\\\\"] ]': 6,
    }
    df = column(spark, list(cases))
    assert [r.e for r in df.select("id", closing_bracket(F.col("t")).alias("e")).orderBy("id").collect()] == list(cases.values())

    def seconds(n):
        rows = column(spark, ['Here: [{"a": 1}] ' + "]" * n]).select(F.size(json_rows(F.col("t"))).alias("n"))
        began = time.perf_counter()
        assert rows.first().n == 1
        return time.perf_counter() - began

    seconds(10)
    assert seconds(80_000) < 8 * max(0.25, seconds(20_000))


def test_calls_of_a_task_overlap_and_fail_alone(spark):
    def complete(_system, user):
        time.sleep(0.1)
        if user == "7":
            raise RuntimeError("no seven")
        return user * 2

    requests = spark.range(24).select(F.col("id").cast("string").alias("key"), F.lit("s").alias("system"), F.col("id").cast("string").alias("user"))
    requests = requests.coalesce(1)
    ask(requests.limit(1), complete).collect()
    began = time.perf_counter()
    got = {r.key: (r.response, r.error) for r in ask(requests, complete, threads=8).collect()}
    assert time.perf_counter() - began < 1.8  # one after another takes 2.4
    assert got == {str(i): (None, "no seven") if i == 7 else (str(i) * 2, None) for i in range(24)}


@pytest.fixture(scope="module")
def claims(spark):
    texts = ["Acme revenue was 5.", "acme profit was 7.", "Zed revenue was 5.", "x", "", "Acme revenue was 5 again."]
    return column(spark, texts, "claim_text").withColumn("id", F.concat(F.lit("f"), "id"))


def test_needles_meet_the_texts_that_hold_them(spark, claims):
    texts = claims.select("id", F.lower("claim_text").alias("text"))
    needles = ["acme", "revenue was 5", "5", "as", "x", "", "acme zed", "was 5 again.", "qqq"]
    got = {(r.id, r.needle) for r in containing(texts, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(r.id, n) for r in texts.collect() for n in needles if n and n in r.text}


def test_gold_report_equals_a_plain_one(spark, claims):
    edges = [("f0", "f1", "contradict"), ("f2", "f0", "corroborate"), ("f5", "f0", "reconcilable"), ("f0", "f0", "contradict"), ("f0", "gone", "contradict")]
    gold = [("acme", "profit", "contradict"), ("profit", "acme", "contradict"), ("zed", "acme", "reconcilable_or_corroborate"), ("", "zed", "corroborate"),
            ("", "", "reconcilable"), ("", "", "unrelated"), ("acme", "", "contradict"), ("nothing", "acme", "contradict"), ("again", "again", "reconcilable")]
    text = {r.id: r.claim_text.lower() for r in claims.collect()}
    rows = [(str(i), *g) for i, g in enumerate(gold)]
    df = spark.createDataFrame(rows, "item string, a_contains string, b_contains string, relation string")
    report = {r.item: (r.a_candidates, r.b_candidates, r.matched) for r in gold_report(claims, spark.createDataFrame(edges, "fact_a_id string, fact_b_id string, relation string"), df).collect()}
    for item, a, b, wanted in rows:
        found = any(
            (r == wanted or wanted == "reconcilable_or_corroborate" and r in ("reconcilable", "corroborate"))
            and (a in text[u] and b in text[v] or b in text[u] and a in text[v])
            for u, v, r in edges if u != v and u in text and v in text
        )
        assert report[item] == (sum(a in t for t in text.values()), sum(b in t for t in text.values()), found), item


def test_hashed_projections_find_most_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    vectors = centres[rng.integers(0, 20, 400)] + 0.2 * rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    exact = {(r.query_id, r.base_id): r.distance for r in nearest_join(df, df, 5).collect()}
    near = {(r.query_id, r.base_id): r.distance for r in lsh_join(df, df, 5).collect()}
    both = near.keys() & exact.keys()
    assert len(both) >= 0.9 * len(exact) and all(abs(near[p] - exact[p]) < 1e-8 for p in both)


def test_sinks_round_trip_with_empty_cells_and_no_rows(spark, tmp_path):
    names = [c.split()[0] for c in FACTS.split(", ")]
    plain = {c: None for c in names} | {"scope_qualifiers": [], "page": 1, "confidence": 0.5}
    rows = [plain | {"id": "1", "subject": "", "evidence_span": 'line\nbreak, "quoted"', "value": "\\"}, plain | {"id": "2", "scope_qualifiers": ["a", "b"], "normalized_value": 2.5}]
    facts = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], FACTS)
    edges = spark.createDataFrame([], EDGES)
    flat = FACTS.replace("scope_qualifiers array<string>", "scope_qualifiers string")
    for name, frame in (("full", facts), ("none", facts.limit(0))):
        export_json(frame, edges, f"{tmp_path}/{name}-json")
        export_csv(frame, edges, f"{tmp_path}/{name}-csv")
        assert read_json(spark, f"{tmp_path}/{name}-json/facts", FACTS).orderBy("id").collect() == frame.orderBy("id").collect()
        wanted = frame.withColumn("scope_qualifiers", F.array_join("scope_qualifiers", "|"))
        assert read_csv(spark, f"{tmp_path}/{name}-csv", flat).orderBy("id").collect() == wanted.orderBy("id").collect()
        assert read_json(spark, f"{tmp_path}/{name}-json/edges", EDGES).count() == 0
    assert json.loads(facts.select(F.to_json(F.struct("id")).alias("j")).first().j)
