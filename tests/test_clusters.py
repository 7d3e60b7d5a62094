import random

from factloom.operators.clusters import agreement_clusters, cluster_labels, components

EDGE = "fact_a_id string, fact_b_id string, relation string"


def test_groups_singletons_and_unknown_endpoints(spark):
    facts = spark.createDataFrame([("a", "A", 0.5), ("b", "B", 0.9), ("c", "C", 0.9), ("d", "D", 0.1)],
                                  "id string, claim_text string, confidence double")
    edges = spark.createDataFrame(
        [("a", "b", "corroborate"), ("c", "b", "corroborate"), ("d", "a", "contradict"), ("a", "zz", "corroborate")], EDGE)
    clusters = agreement_clusters(facts, edges)
    assert {r.id: r.cluster_id for r in clusters.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    labels = {r.cluster_id: (r.label, r.size) for r in cluster_labels(clusters, facts).collect()}
    assert labels == {"a": ("B", 3), "d": ("D", 1)}


def test_chain_and_hub(spark):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(60)]
    rng.shuffle(names)
    pairs = [(names[i], names[i + 1]) for i in range(49)] + [("hub", f"x{i}") for i in range(30)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert {got[n] for n in names[:50]} == {min(names[:50])}
    assert {got[f"x{i}"] for i in range(30)} | {got["hub"]} == {"hub"}
    assert len(got) == 81


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
