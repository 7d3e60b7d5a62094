"""A model is asked where a block of facts lies."""


from factloom.operators import blocks
from factloom.operators.relate import PROMPT_COLUMNS, adjudicate_blocks, adjudicate_by_model, candidate_pairs
from factloom.operators.requests import asked_in_runs
from factloom.plans.build import MATCH, related_facts, searchable
from factloom.plans.claims import layer_facts

SF = "/root/testdata/sf0.001"


def test_edges_of_a_model_are_those_of_the_join_without_a_shuffle_of_prompts(spark, monkeypatch):
    def judge(_system, user):
        if user.count("1") % 5 == 0:
            raise RuntimeError("no answer")
        return '{"relation": "corroborate", "reconciling_dimension": "none", "reasoning": "r", "confidence": 0.5}'

    facts = layer_facts(spark, SF).where("subject < 'Customer#000000020'")
    wanted, _ = adjudicate_by_model(candidate_pairs(searchable(facts), match=MATCH), facts, judge)
    wanted = sorted(map(tuple, wanted.collect()))
    assert wanted
    found = adjudicate_blocks(related_facts(facts, PROMPT_COLUMNS), judge, keep=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, found.collect())) == wanted
    assert sorted(map(tuple, adjudicate_blocks(related_facts(facts, PROMPT_COLUMNS), judge).collect())) == wanted
    usual = blocks.nearest_in_blocks
    monkeypatch.setattr("factloom.plans.build.nearest_in_blocks", lambda *a, **k: usual(*a, **k, block_rows=8))
    assert sorted(map(tuple, adjudicate_blocks(related_facts(facts, PROMPT_COLUMNS), judge).collect())) == wanted


def test_equal_requests_of_a_run_are_asked_once(spark):
    import pandas as pd

    asked = []
    run = asked_in_runs(lambda system, user: asked.append(user) or user.upper(), "s", 2)
    frames = [pd.DataFrame({"block": list(b), "user": list(u)}) for b, u in (("aab", "xxx"), ("", ""), ("bbc", "xyx"))]
    out = pd.concat(list(run(iter(frames))))
    assert list(out["response"]) == list("XXXXYX")
    assert sorted(asked) == ["x", "x", "x", "y"]


def test_a_verdict_is_read_once(spark):
    from factloom.operators.relate import adjudicated

    rows = [("a", "b", 'so {"relation": "corroborate", "confidence": 0.5} it is'), ("a", "c", "{no object"), ("a", "d", '{"relation": "other"}')]
    edges = adjudicated(spark.createDataFrame(rows, "fact_a_id string, fact_b_id string, response string"))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
    assert [(r.fact_b_id, r.relation, r.confidence) for r in edges.collect()] == [("b", "corroborate", 0.5)]
