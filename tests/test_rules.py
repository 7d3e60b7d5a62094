import pytest
from pyspark.sql import functions as F

from factloom.functions.normalize import (
    canonical_subject, canonical_unit, normalize_facts, parse_number, parse_period, resolve_scale,
)
from factloom.functions.responses import adjudication, claim_fields, json_rows, response_claims, strip_fences, valid_rows
from factloom.operators.extraction import model_claims, pattern_claims
from factloom.operators.relate import adjudicate_by_rules, distinct_pairs, informative
from factloom.operators.chunking import chunk_documents
from factloom.operators.requests import ask_cached, request_key
from factloom.schemas import CLAIM_FIELDS, FACTS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,number", [
    ("8,142", 8142.0), (" 1.2 ", 1.2), ("1 000", 1000.0), ("n/a", None), ("", None), ("abc", None), ("5.9%", None),
    ("1d", None), ("nan", None), ("5.", 5.0), (".5", 0.5), ("-3e2", -300.0)])
def test_numbers(spark, text, number):
    assert one(spark, parse_number(F.lit(text))) == number


@pytest.mark.parametrize("text,start,end", [
    ("FY24", "2023-04-01", "2024-03-31"), ("fy2024", "2023-04-01", "2024-03-31"), ("Q1FY24", "2023-04-01", "2023-06-30"),
    ("Q2FY24", "2023-07-01", "2023-09-30"), ("Q3FY24", "2023-10-01", "2023-12-31"), ("Q4FY24", "2024-01-01", "2024-03-31"),
    ("CY2024", "2024-01-01", "2024-12-31"), (" 2024 ", "2024-01-01", "2024-12-31"), ("as of 2024-03-31", "2024-03-31", "2024-03-31"),
    ("As Of 2024/03/31 or so", "2024-03-31", "2024-03-31"), ("as of 03/31/2024", "2024-03-31", "2024-03-31"),
    ("sometime last year", None, None), ("", None, None), ("Q5FY24", None, None), ("FY199", "198-04-01", "199-03-31")])
def test_periods(spark, text, start, end):
    got = one(spark, parse_period(F.lit(text)))
    assert (got.period_start, got.period_end) == (start, end)


@pytest.mark.parametrize("unit,scale,rest", [
    ("INR Cr", 1e7, "INR"), ("million USD", 1e6, "USD"), ("kg", 1.0, "kg"), ("m", 1.0, "m"), ("USD/m", 1e6, "USD"),
    ("lakh", 1e5, ""), ("a lakh crore", 1e5, "a crore"), ("", 1.0, "")])
def test_scales(spark, unit, scale, rest):
    got = one(spark, resolve_scale(F.lit(unit)))
    assert (got.multiplier, got.remainder) == (scale, rest)


def test_units_and_subjects(spark):
    for unit, name in [("kg", "kilogram"), ("percent", "%"), ("%", "%"), ("Crore", "crore"), ("INR", "INR"), (" ", "")]:
        assert one(spark, canonical_unit(F.lit(unit))) == name
    for subject, name in [("  Acme Corp.  ", "acme corp"), ("-A-B, \t(Ltd)-", "a-b ltd"), ("", "")]:
        assert one(spark, canonical_subject(F.lit(subject))) == name


def test_normalised_fact(spark):
    rows = [("8,142", "INR Cr", "FY24", "Acme"), ("5", "lakh", "x", "Acme"), ("7.5", "%", "", "Acme"), ("n/a", "", "", "Acme")]
    got = normalize_facts(spark.createDataFrame(rows, "value string, unit string, temporal_context string, subject string")).collect()
    assert [(r.normalized_value, r.normalized_unit, r.period_start) for r in got] == [
        (81420000000.0, "INR", "2023-04-01"), (500000.0, "lakh", None), (7.5, "%", None), (None, None, None)]


ROW = {"subject": "S", "attribute": "a", "value": 5, "unit": "u", "temporal_context": "FY24", "scope_qualifiers": ["x", "y"],
       "evidence_span": "Revenue was 5", "claim_text": "c", "fact_kind": "numerical", "confidence": 0.9}


def claims_of(spark, response):
    df = spark.createDataFrame([("d", "So: Revenue\nwas 5 in all", response)], "doc_id string, chunk_text string, response string")
    return response_claims(df, ["doc_id"]).collect()


def test_response_shapes(spark):
    import json

    row = json.dumps(ROW)
    for response in (f"[{row}]", f"```json\n[{row}]\n```", f"Here: [{row}] and more [1]", f'{{"facts": [{row}]}}',
                     "[" + json.dumps(ROW | {"claim_text": "a ] b"}) + "] tail", '["x", 3, ' + row + "]"):
        (claim,) = claims_of(spark, response)
        assert (claim.value, claim.confidence, claim.scope_qualifiers) == ("5", 0.9, ["x", "y"])
    for response in ("", "no json", "[", "{}", json.dumps([{k: v for k, v in ROW.items() if k != "unit"}]),
                     json.dumps([ROW | {"evidence_span": "NOT IN TEXT"}]), json.dumps([ROW | {"evidence_span": ""}]),
                     json.dumps([ROW | {"evidence_span": None}])):
        assert claims_of(spark, response) == []
    (odd,) = claims_of(spark, json.dumps([ROW | {"confidence": "high", "scope_qualifiers": "x", "unit": None}]))
    assert (odd.confidence, odd.scope_qualifiers) == (0.5, [])
    assert one(spark, strip_fences(F.lit("```"))) == ""
    assert one(spark, F.size(valid_rows(json_rows(F.lit("[1]"))))) == 0
    assert set(claim_fields(F.lit(None))) == set(CLAIM_FIELDS)


@pytest.mark.parametrize("response,expected", [
    ('{"relation":"contradict","reconciling_dimension":"none","confidence":0.8,"reasoning":"r"}', ("contradict", "none", 0.8)),
    ('x {"relation":"reconcilable","reconciling_dimension":"time","reasoning":"a } b","confidence":"0.5"} y', ("reconcilable", "time", 0.5)),
    ('{"relation":"contradict","reconciling_dimension":"bogus"}', ("contradict", "none", 0.0)),
    ('{"relation":"agree"}', None), ("nope", None), ('{"relation":"contradict","confidence":"x"}', None), ("[1]", None)])
def test_adjudication_replies(spark, response, expected):
    got = one(spark, adjudication(F.lit(response)))
    assert expected == (got and (got.relation, got.reconciling_dimension, got.confidence))


def fact(i, subject="co", attribute="revenue", value="100", number=100.0, unit="INR", period="2023-04-01", scope=(), confidence=0.9):
    return (i, f"d{i}", subject, attribute, value, unit, "", list(scope), "e", 1, f"claim {i}", "numerical", confidence, number, unit,
            period, period and "2024-03-31", subject)


@pytest.mark.parametrize("a,b,relation,dimension", [
    ({}, {}, "corroborate", "none"), ({}, {"number": 200.0}, "contradict", "none"), ({}, {"number": 100.4}, "corroborate", "none"),
    ({}, {"period": "2022-04-01", "number": 200.0}, "reconcilable", "time"), ({}, {"subject": "other"}, "unrelated", "none"),
    ({}, {"attribute": "Revenue "}, "corroborate", "none"), ({"unit": "kg"}, {"unit": "lb", "number": 220.0}, "reconcilable", "unit"),
    ({"scope": ["consolidated"]}, {"scope": ["standalone"], "number": 50.0}, "reconcilable", "scope"),
    ({"number": None, "value": "North"}, {"number": None, "value": " north"}, "corroborate", "none"),
    ({"number": None, "value": "North"}, {"number": None, "value": "South"}, "contradict", "none"),
    ({"number": None}, {}, "unrelated", "none"), ({"period": None}, {"number": 200.0}, "contradict", "none")])
def test_rules(spark, a, b, relation, dimension):
    facts = spark.createDataFrame([fact("1", **a), fact("2", **b)], FACTS)
    pairs = spark.createDataFrame([("1", "2"), ("1", "gone")], "fact_a_id string, fact_b_id string")
    (edge,) = adjudicate_by_rules(pairs, facts).collect()
    assert (edge.relation, edge.reconciling_dimension, edge.confidence) == (relation, dimension, 0.9)
    assert informative(adjudicate_by_rules(pairs, facts)).count() == (relation != "unrelated")


def test_pairs_once(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "fact_a_id string, fact_b_id string")
    assert [tuple(r) for r in distinct_pairs(pairs).collect()] == [("a", "b")]


CHUNK = "doc_id string, page int, chunk_no int, text string, char_start long, char_end long, section_hint string"
PAGE = "doc_id string, page int, text string, char_start long"


def test_pattern_claims(spark):
    text = ("Annual report\n  Acme Ltd revenue was about 8,142 crore INR in FY24 (consolidated, audited).\nAcme Ltd margin was 7.5% in CY2023.\n"
            "Acme Ltd region was North Bay.\nThis line is prose, and not a claim.\nStaff count was 12.")
    rows = [("d", 1, text, 0), ("d", 2, "me Ltd revenue was big\nAcme Ltd debt was 3 USD as of 2024-03-31.", 300)]
    got = pattern_claims(spark.createDataFrame(rows, PAGE)).orderBy("seq").collect()
    assert [(r.subject, r.attribute, r.value, r.unit, r.temporal_context, r.scope_qualifiers, r.fact_kind, r.confidence) for r in got] == [
        ("Acme Ltd", "revenue", "8,142", "crore INR", "FY24", ["consolidated", "audited"], "numerical", 0.7),
        ("Acme Ltd", "margin", "7.5", "%", "CY2023", [], "numerical", 0.95),
        ("Acme Ltd", "region", "North Bay", "", "", [], "semantic", 0.75),
        ("Staff", "count", "12", "", "", [], "numerical", 0.8),
        ("Acme Ltd", "debt", "3", "USD", "as of 2024-03-31", [], "numerical", 0.95)]
    assert len({r.id for r in got}) == 5


def test_claims_do_not_depend_on_where_chunks_end(spark):
    """The chunk ends at every place of a line, longer and shorter than the overlap; nothing is lost or cut."""
    line = "Acme and " + "a very long " * 4 + "group revenue was about 12.34 million USD in FY2024."
    pages = [(f"d{n}", 1, "x" * n + f"\n{line}\nAcme debt was 3 USD.", 0) for n in range(150)]
    got = pattern_claims(spark.createDataFrame(pages, PAGE), max_chars=100, overlap=15).collect()
    assert sorted((r.doc_id, r.value) for r in got) == sorted((p[0], v) for p in pages for v in ("12.34", "3"))
    assert all(r.claim_text in (line, "Acme debt was 3 USD.") for r in got) and len({r.id for r in got}) == 300
    starts = {c.char_start for c in chunk_documents(spark.createDataFrame([("d99", pages[99][2])], "doc_id string, text string"), 100, 15).collect()}
    assert {r.char_start for r in got if r.doc_id == "d99"} <= starts


def test_model_claims_and_failures(spark):
    import json

    rows = [("d1", 1, 0, "Revenue was 5 here", 0, 18, ""), ("d2", 1, 0, "boom", 0, 4, ""), ("d3", 1, 0, "Revenue was 5 here", 0, 18, "")]

    def model(_system, user):
        if "boom" in user:
            raise RuntimeError("down")
        return json.dumps([ROW])

    claims, report, fresh = model_claims(spark.createDataFrame(rows, CHUNK), model)
    assert sorted(r.doc_id for r in claims.collect()) == ["d1", "d3"]
    assert {r.doc_id: (r.n_chunks, r.n_failed, r.n_raw, r.no_facts) for r in report.collect()} == {
        "d1": (1, 0, 1, False), "d2": (1, 1, 0, True), "d3": (1, 0, 1, False)}


def test_cache_asks_only_misses_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(_system, user):
        asked.add(1)
        return user.upper()

    requests = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("s", "c")], "system string, user string")
    requests = requests.withColumn("key", request_key("m", F.col("system"), F.col("user")))
    cache = requests.where("user = 'c'").select("key", F.lit("old").alias("response"))
    answers, fresh = ask_cached(requests, model, cache)
    assert sorted(r.response for r in answers.collect()) == ["A", "B", "old"]
    assert fresh.count() == 2 and asked.value == 2
