"""Upserts of rows with nulls and nested values, and the settings of the package's own writes."""

from pyspark.sql import functions as F

from factloom.operators.layer import upsert_by_id
from factloom.session import materialize, own_write

SCHEMA = "version int, id string, text string, value double, tags array<string>"


def test_latest_row_stays_whole_and_ties_do_not_depend_on_order(spark):
    old = [(1, "a", "x", 1.0, ["p"]), (1, "b", None, None, None), (1, None, "n", 0.0, []), (2, "c", "keep", 2.0, None)]
    new = [(2, "a", None, 3.0, None), (1, "c", "late", 9.0, ["q"]), (1, "d", None, "t", None), (1, "d", "t", None, None)]
    new = [(v, i, t, x if isinstance(x, float) else None, g) for v, i, t, x, g in new]
    kept = None
    for turned in (False, True):
        sides = [spark.createDataFrame(r[::-1] if turned else r, SCHEMA) for r in (old, new)]
        found = upsert_by_id(*sides)
        assert found.columns == sides[0].columns
        rows = {r.id: tuple(r) for r in found.collect()}
        assert rows["a"] == (2, "a", None, 3.0, None) and rows["c"] == (2, "c", "keep", 2.0, None)
        assert rows["b"] == (1, "b", None, None, None) and rows[None] == (1, None, "n", 0.0, [])
        assert kept is None or kept == rows
        kept = rows


def test_the_key_of_an_upsert_is_shuffled_once(spark):
    stored = spark.range(1000).select(F.concat(F.lit("fact_"), F.md5(F.col("id").cast("string"))).alias("id"), F.lit(1).alias("version"))
    plan = upsert_by_id(stored, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "struct(id, id" not in plan


def test_own_writes_keep_methods_to_what_the_jvm_compiles(spark):
    """A stage whose generated method is over 8,000 bytes is not compiled by the JVM: it is split within writes."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with own_write(spark):
        assert int(spark.conf.get(name)) == 8000
    assert spark.conf.get(name) == before
    assert materialize(spark.range(5), "five").count() == 5 and spark.conf.get(name) == before
