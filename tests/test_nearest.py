import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators.nearest import collection_size, filter_metadata, nearest_join, nearest_to
from factloom.operators.pivot_tree import PivotTree


def make(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    vectors = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    if copies:
        vectors[:copies] = vectors[0]
    vectors[n - 1] = 0.0
    return [
        (i, [float(x) for x in v], f"g{i % 3}", f"d{i % 7}", int(i // 5)) for i, v in enumerate(vectors)
    ]


def brute(queries, base, k, match, differ, earlier):
    def unit(v):
        v = np.array(v)
        n = np.linalg.norm(v)
        return v / n if n else v

    out = {}
    units = [unit(r[1]) for r in base]
    for q in queries:
        uq = unit(q[1])
        rows = []
        for b, ub in zip(base, units):
            if match and q[2] != b[2] or differ and q[3] == b[3] or earlier and b[4] >= q[4]:
                continue
            rows.append((round(1 - float(uq @ ub), 9) + 0.0, b[4] if earlier else 0, b[0]))
        out[q[0]] = [(i, d) for d, _, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("copies", [0, 100])
@pytest.mark.parametrize(
    "match,differ,earlier,cells",
    [(0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, None), (0, 0, 0, 9), (0, 1, 1, 9), (0, 1, 0, 5)],
)
def test_matches_brute_force(spark, copies, match, differ, earlier, cells):
    schema = "id long, embedding array<double>, grp string, doc string, seq long"
    rows = make(300, 8, 3, copies)
    df = spark.createDataFrame(rows, schema)
    got = nearest_join(
        df, df, 4,
        match=["grp"] if match else None,
        differ="doc" if differ else None,
        earlier="seq" if earlier else None,
        cells=cells,
        rows_per_task=40,
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.base_id, r.distance))
    expected = brute(rows, rows, 4, match, differ, earlier)
    assert found == {q: v for q, v in expected.items() if v}


def test_hot_blocks_take_the_regions(spark):
    rows = [(i, v, "hot" if i % 3 else f"g{i % 4}", d, s) for i, v, _, d, s in make(240, 6, 9, 20)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, grp string, doc string, seq long")
    got = nearest_join(df, df, 3, match=["grp"], differ="doc", earlier="seq", cells=5, rows_per_task=40, hot_block=100)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.base_id, r.distance))
    assert found == {q: v for q, v in brute(rows, rows, 3, 1, 1, 1).items() if v}


def test_probes_give_a_subset_with_good_recall(spark):
    rows = make(400, 8, 5)
    df = spark.createDataFrame(rows, "id long, embedding array<double>, grp string, doc string, seq long")
    exact = {(r.query_id, r.base_id) for r in nearest_join(df, df, 5, cells=8).collect()}
    near = {(r.query_id, r.base_id) for r in nearest_join(df, df, 5, cells=8, probes=3).collect()}
    assert len(near) == len(exact)
    assert len(near & exact) / len(exact) > 0.8


def test_single_query_and_filters(spark):
    rows = [("a", [1.0, 0.0], "d1"), ("b", [0.0, 1.0], "d2"), ("c", [1.0, 1.0], "d2")]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, doc_id string")
    assert [r.id for r in nearest_to([1.0, 0.1], df, 2).collect()] == ["a", "c"]
    assert [r.id for r in nearest_to([1.0, 0.1], df, 9, where={"doc_id": {"$ne": "d1"}}).collect()] == ["c", "b"]
    assert [r.id for r in filter_metadata(df, {"doc_id": "d1"}).collect()] == ["a"]
    assert collection_size(df).first().size == 3


def test_work_for_a_query_does_not_grow_with_the_table(spark):
    """Four times the table, in four times as many clusters: a query visits no more leaves."""

    def visited(clusters):
        rng = np.random.default_rng(8)
        centres = rng.normal(size=(clusters, 6))
        vectors = np.repeat(centres, 40, axis=0) + 0.01 * rng.normal(size=(clusters * 40, 6))
        rows = [(i, [float(x) for x in v], "", "", 0) for i, v in enumerate(vectors)]
        base = spark.createDataFrame(rows, "id long, vec array<double>, match string, differ string, earlier long")
        tree = PivotTree(base, 100, 400)
        asked = tree.homes(base.where("id % 40 = 0")).withColumnRenamed("cell", "home").withColumn("bound", F.lit(0.001))
        leaves = tree.leaves.groupBy("cell").count()
        assert leaves.agg(F.max("count")).first()[0] <= 100 and tree.leaves.count() == len(rows)
        return tree.visits(asked, (False, False, False)).count() / asked.count()

    assert visited(160) <= 2 * max(1.0, visited(40))
