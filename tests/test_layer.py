import json

from pyspark.sql import functions as F

from factloom.operators import layer as L
from factloom.operators.cases import build_cases, case_details
from factloom.operators.evaluate import extraction_sanity, gold_report, gold_summary
from factloom.operators.qa import REFUSAL, UNREADABLE, answer, citations, retrieve
from factloom.functions.vectors import encode_with, hash_embedding, token_embedding
from factloom.schemas import DOCUMENTS, EDGES, FACTS
from factloom.sources.records import export_csv, export_json, from_records, list_from_json, read_gold, to_records


def fact(i, confidence=0.9, claim=None, value=1.0, scope=(), doc=None, evidence="e"):
    return (i, doc or f"d-{i}", "Co", "revenue", "100", "INR Cr", "FY24", list(scope), evidence, 3, claim or f"claim {i}", "numerical",
            confidence, value, "INR", "2023-04-01", "2024-03-31", "co")


def edge(i, a, b, relation, confidence):
    return (i, a, b, relation, "why", "none", confidence)


def test_upserts(spark):
    schema = "id string, content_hash string, status string, version long"
    stored = spark.createDataFrame([("1", "h1", "a", 1), ("2", "h2", "a", 2), ("5", "h5", "a", 3)], schema)
    sent = spark.createDataFrame([("1", "h9", "b", 4), ("3", "h2", "b", 5), ("3", "h7", "b", 6)], schema)
    got = L.upsert_documents(stored, sent).collect()
    assert sorted((r.id, r.content_hash) for r in got) == [("1", "h9"), ("3", "h7"), ("5", "h5")]
    again = L.upsert_by_id(stored.drop("content_hash"), sent.drop("content_hash"))
    assert sorted((r.id, r.status) for r in again.collect()) == [("1", "b"), ("2", "a"), ("3", "b"), ("5", "a")]
    for rows in (stored, stored.unionByName(stored)):
        for upsert in (L.upsert_documents, L.upsert_by_id):
            assert sorted(map(tuple, upsert(stored, rows).collect())) == sorted(map(tuple, stored.collect()))
    tied = spark.createDataFrame([("1", "h1", "b", 1), ("1", "h1", "c", 1)], schema)
    assert [r.status for r in L.upsert_by_id(stored, tied).where("id = '1'").collect()] in (["b"], ["c"])


def test_fact_queries(spark):
    facts = spark.createDataFrame([fact("a", doc="d1"), fact("b", 0.4, doc="d1"), fact("c", doc="d2")], FACTS)
    docs = spark.createDataFrame([("d1", "f", "h1", 1, "done", "2"), ("d2", "f", "h2", 1, "done", "1"), ("d3", "f", "h3", 1, "done", "3")], DOCUMENTS)
    edges = spark.createDataFrame([edge("1", "a", "c", "contradict", 0.9), edge("2", "a", "gone", "corroborate", 0.9), edge("3", "b", "a", "corroborate", 0.9)], EDGES)
    assert [r.id for r in L.filter_facts(facts, 0.5, doc_id="d1").collect()] == ["a"]
    assert [r.id for r in L.fact_page(facts, 1, 1).collect()] == ["b"]
    assert L.by_id(facts, "c").first().doc_id == "d2"
    assert [r.id for r in L.document_list(docs).collect()] == ["d2", "d1", "d3"]
    assert {r.id: r.n_facts for r in L.documents_with_counts(docs, facts).collect()} == {"d1": 2, "d2": 1, "d3": 0}
    assert sorted(r.id for r in L.edges_of_document(edges, facts, "d1").collect()) == ["1", "3"]
    assert sorted(r.id for r in L.edges_of_document(edges, facts, "d2").collect()) == ["1"]
    rich = {r.id: r.b for r in L.enriched_edges(edges, facts, ["claim_text"]).collect()}
    assert rich["2"] is None and rich["1"].claim_text == "claim c"
    assert tuple(L.layer_totals(docs, facts, edges).first()) == (3, 3, 3)
    assert [(r.attribute, r.n) for r in L.add_to_vocabulary(L.attribute_vocabulary(facts), facts).collect()] == [("revenue", 6)]
    labels = facts.limit(1).select(L.confidence_band(F.lit(None)).alias("a"), L.confidence_percent(F.lit(0.876)).alias("b"),
                                   L.period_label(F.lit(""), F.lit("2023-04-01")).alias("c"), L.period_label(F.lit(None), F.lit(None)).alias("d"))
    assert tuple(labels.first()) == ("low", 88, "2023-04", "-")


def test_cases_prefer_distinct_facts(spark):
    facts = spark.createDataFrame([fact(x) for x in "abcdef"] + [fact("g", 0.05)], FACTS)
    edges = spark.createDataFrame([
        edge("e1", "a", "b", "corroborate", 0.95), edge("e2", "a", "c", "reconcilable", 0.85),
        edge("e3", "e", "f", "reconcilable", 0.75), edge("e4", "c", "d", "contradict", 0.88)], EDGES)
    got = {r.slot: r for r in build_cases(facts, edges).collect()}
    assert {s: r.edge_id for s, r in got.items()} == {"corroborate": "e1", "contradict": "e4", "reconcilable": "e3", "failure": None}
    assert got["failure"].fact_a_id == "g"
    shared = edges.where("id in ('e1', 'e2')")
    assert {r.slot: r.edge_id for r in build_cases(facts, shared).collect()}["reconcilable"] == "e2"
    assert {r.slot: r.a.claim_text for r in case_details(build_cases(facts, shared), facts).collect()}["failure"] == "claim g"
    assert build_cases(facts.limit(0), edges).count() == 0


def test_evaluation(spark, tmp_path):
    facts = spark.createDataFrame([fact("a", claim="Revenue was 5"), fact("b", claim="The REVENUE was 6"), fact("c", value=None, claim="GDP", evidence=" ")], FACTS)
    edges = spark.createDataFrame([edge("1", "a", "b", "unrelated", 1.0), edge("2", "b", "a", "corroborate", 1.0)], EDGES)
    items = [{"a_contains": "was 5", "b_contains": "was 6", "relation": "reconcilable_or_corroborate"},
             {"a_contains": "gdp", "b_contains": "revenue", "relation": "contradict", "note": "n"}, {"relation": "corroborate"}]
    (tmp_path / "gold.json").write_text(json.dumps({"expected_relations": items}, indent=1))
    gold = read_gold(spark, str(tmp_path / "gold.json"))
    report = {int(r.item.split("#")[1]): r for r in gold_report(facts, edges, gold).collect()}
    assert [(report[i].matched, report[i].a_candidates, report[i].b_candidates, report[i].note) for i in (1, 2, 3)] == [
        (True, 1, 1, ""), (False, 1, 2, "n"), (True, 3, 3, "")]
    assert tuple(gold_summary(gold_report(facts, edges, gold)).first())[:2] == (3, 2)
    sanity = extraction_sanity(facts).first()
    assert (sanity.total_facts, sanity.facts_with_evidence_span, sanity.facts_with_normalized_value) == (3, 2, 2)
    assert extraction_sanity(facts.limit(0)).first().pct_with_evidence_span == 0.0
    assert gold_summary(gold_report(facts, edges, gold.limit(0))).first().gold_match_pct == 0.0


def test_question_answering(spark):
    facts = spark.createDataFrame([fact("f1", claim="Acme revenue was 5"), fact("f2", claim="Zed profit was 9")], FACTS)
    facts = facts.withColumn("embedding", token_embedding(F.col("claim_text")))
    questions = spark.createDataFrame([(1, "revenue of Acme"), (2, "profit of Zed")], "question_id long, question string")
    questions = questions.withColumn("embedding", token_embedding(F.col("question")))
    answers, cited = answer(questions, facts)
    assert {r.question_id: r.answer for r in answers.collect()} == {1: "Acme revenue was 5", 2: "Zed profit was 9"}
    assert {r.question_id: r.fact_id for r in cited.collect()} == {1: "f1", 2: "f2"}
    reply = lambda _s, user: "bad" if "Zed?" in user else '{"answer": "five", "cited_fact_ids": ["f2", "nonexistent", "f1"]}'
    answers, cited = answer(questions, facts, reply, top_k=1)
    assert {r.answer for r in answers.collect()} == {"five"}
    assert sorted((r.question_id, r.fact_id) for r in cited.collect()) == [(1, "f1"), (2, "f2")]
    found = retrieve(questions, facts, 1)
    said = spark.createDataFrame([(1, ["f2"])], "question_id long, cited array<string>")
    assert citations(said, found).count() == 0 and citations(said, found, facts).count() == 1
    answers, cited = answer(questions, facts.limit(0), reply)
    assert {r.answer for r in answers.collect()} == {REFUSAL} and cited.count() == 0
    answers, _ = answer(questions, facts, lambda _s, _u: "no object")
    assert {r.answer for r in answers.collect()} == {UNREADABLE}


def test_records_and_exports(spark, tmp_path):
    facts = spark.createDataFrame([fact("a", scope=["x", "y"], claim='say "hi", ok')], FACTS)
    edges = spark.createDataFrame([], EDGES)
    assert from_records(to_records(facts).withColumn("junk", F.lit(1))).collect() == facts.collect()
    assert spark.range(1).select(list_from_json(F.lit("oops")).alias("x")).first().x == []
    export_csv(facts, edges, str(tmp_path / "f"), "anything")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "f")).first()
    assert (back.scope_qualifiers, back.claim_text) == ("x|y", 'say "hi", ok')
    export_csv(facts, edges, str(tmp_path / "e"), "edges")
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == [c.split()[0] for c in EDGES.split(", ")]
    export_json(facts, edges, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j/facts")).first().value)["scope_qualifiers"] == ["x", "y"]


def test_embeddings(spark):
    import hashlib
    import math

    digest = hashlib.sha256("héllo".encode()).digest()
    raw = [digest[i % 32] / 255 * 2 - 1 for i in range(40)]
    expected = [x / math.sqrt(sum(v * v for v in raw)) for x in raw]
    rows = spark.createDataFrame([("héllo",)], "t string")
    got = rows.select(hash_embedding(F.col("t"), 40).alias("v")).first().v
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, expected))
    assert encode_with(rows, "t", lambda texts: [[len(t), 1] for t in texts]).first().embedding == [5.0, 1.0]


def test_a_discarded_table_is_gone_and_others_stay(spark):
    import pathlib

    from factloom.session import discard, materialize

    first, second = materialize(spark.range(3), "first"), materialize(spark.range(4), "second")
    discard(first, second.where("id > 1"))
    assert not pathlib.Path(first.written_to).exists() and second.count() == 4
