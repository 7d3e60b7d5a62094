"""Related pairs of a block are found where the block lies."""

from pyspark.sql import functions as F

from factloom.operators import blocks
from factloom.operators.blocks import components_in_blocks, nearest_in_blocks
from factloom.operators.evaluate import containing
from factloom.operators.nearest import nearest_join


def _rows(spark):
    """Blocks of 1 to 400 rows, many of them copies."""
    rows = spark.range(600).select(
        F.format_string("f%03d", "id").alias("id"),
        F.when(F.col("id") < 400, "big").when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 30)).alias("k"),
        F.concat(F.lit("d"), F.col("id") % 7).alias("doc_id"),
        (F.col("id") % 5).alias("seq"),
        F.when(F.col("id") != 3, F.array(*[(F.hash(F.col("id") % 11, F.lit(i)) % 5).cast("double") for i in range(4)])).alias("embedding"),
    )
    return rows.cache()


def _pairs(found):
    return sorted((r.query_id, r.base_id, r.distance, r["rank"]) for r in found.collect())


def test_blocks_give_the_pairs_of_the_join_with_the_columns_of_both_rows(spark):
    rows = _rows(spark)
    wanted = _pairs(nearest_join(rows, rows, 3, match=["k"], differ="doc_id", earlier="seq"))
    assert wanted
    for limit in (1 << 14, 100):
        found = nearest_in_blocks(
            rows, 3, match=["k"], differ="doc_id", earlier="seq", embed=lambda r: r, columns=["doc_id", "seq"], block_rows=limit
        )
        assert _pairs(found) == wanted
        docs = {r.id: (r.doc_id, r.seq) for r in rows.collect()}
        for r in found.collect():
            assert (r.a.doc_id, r.a.seq) == docs[r.query_id] and (r.b.doc_id, r.b.seq) == docs[r.base_id]
            assert (r.block is None) == (limit == 100 and r.query_id < "f400")


def test_pairs_meet_in_no_window_and_join_no_rows(spark):
    rows = _rows(spark)
    found = nearest_in_blocks(rows, 3, match=["k"], differ="doc_id", earlier="seq", embed=lambda r: r, columns=["doc_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Repartition") == 1


def test_folded_blocks_lose_no_pair(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(5)
    vectors = draw.integers(0, 2, (300, 3)).astype(float)
    owners, times = draw.integers(0, 9, 300), np.sort(draw.integers(0, 6, 300))
    folded = blocks._nearest_of_block(vectors, owners, times, 4)
    monkeypatch.setattr(blocks, "FOLD_ROWS", 1000)
    for one, other in zip(folded, blocks._nearest_of_block(vectors, owners, times, 4)):
        assert one.tolist() == other.tolist()


def test_components_of_runs_and_of_pairs_without_a_block(spark):
    pairs = [("x", "b", "a"), ("x", "c", "b"), ("y", "e", "d"), (None, "h", "g"), (None, "g", "f")]
    found = components_in_blocks(spark.createDataFrame(pairs, "block string, u string, v string").coalesce(1))
    assert sorted(map(tuple, found.collect())) == [(v, r) for v, r in zip("abcdefgh", "aaaddfff")]


def test_few_needles_and_many_find_the_same(spark, monkeypatch):
    from factloom.operators import evaluate

    texts = spark.createDataFrame([(i, f"claim {i:03d} of {i % 7}") for i in range(90)], "id int, text string")
    needles = spark.createDataFrame([("01",), ("of 3",), ("",), ("m 08",), ("7",), ("none",)], "needle string")
    few = sorted(map(tuple, containing(texts, needles).collect()))
    monkeypatch.setattr(evaluate, "FEW_NEEDLES", 0)
    assert few == sorted(map(tuple, containing(texts, needles).collect()))
    assert len(few) == sum(n in f"claim {i:03d} of {i % 7}" for i in range(90) for n in ("01", "of 3", "m 08", "7"))


def test_ids_are_packed_for_the_shuffle_and_come_back_as_they_were(spark):
    digits = "0123456789abcdef" * 2
    ids = [f"fact_{digits}", f"_{digits}", digits, f"fact_{digits.upper()}", "fact_1", "", "\u00fc\0\1", f"{'x' * 16}\1", None]
    rows = spark.createDataFrame([(x,) for x in ids], "id string").select("id", blocks._packed(F.col("id")).alias("p"))
    rows = rows.select("id", F.length("p").alias("n"), blocks._unpacked(F.col("p")).alias("back")).collect()
    assert [r.back for r in rows] == ids
    assert rows[0].n == 22
