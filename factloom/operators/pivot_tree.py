"""Exact nearest neighbours without an equality key: a tree of pivot regions, built and searched by Spark.

A region of more than ``leaf_rows`` rows is split by pivots of its own, level after level, so leaves are
bounded however large the table is. A query first searches the leaf it falls into, which bounds its k-th
distance, then goes down from the root only where the triangle inequality leaves a nearer row possible.
Pivots stay in tables: rows and queries meet the pivots of their region in tasks of a set size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.session import materialize

#: Pivots of a region, and levels at most (region numbers are BRANCH-ary and fit a long).
BRANCH, LEVELS = 32, 10
_TOLERANCE = 1e-6
_PIVOT = ["cell", "child", "pivot", "radius", "first", "only"]


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero."""
    column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors to the pivots."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ pivots.T), 0.0))


def _met(rows: DataFrame, pivots: DataFrame, rows_per_task: int, choose: Callable, schema: T.StructType) -> DataFrame:
    """``choose(rows, pivots)`` for the rows of each region with its pivots; hot regions are many tasks."""
    slices = rows.groupBy("cell").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_slices"))
    own = rows.join(slices, "cell").withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    theirs = pivots.select(*_PIVOT).join(slices, "cell").select(*_PIVOT, every)
    empty = to_arrow_schema(schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return choose(left, right) if left.num_rows and right.num_rows else empty

    return own.drop("_slices").groupBy("cell", "_slice").cogroup(theirs.groupBy("cell", "_slice")).applyInArrow(run, schema)


def _columns(rows: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    """Fields of ``rows`` but ``cell`` and ``reach``, then ``cell`` and more."""
    kept = [f for f in rows.schema.fields if f.name not in ("cell", "reach")]
    return T.StructType([*kept, T.StructField("cell", T.LongType()), *[T.StructField(n, t) for n, t in more]])


def _to_nearest(rows: DataFrame, pivots: DataFrame, rows_per_task: int) -> DataFrame:
    """Move each row to the child region of its nearest pivot; ``reach`` is its distance to it."""
    schema = _columns(rows, ("reach", T.DoubleType()))
    arrow, names = to_arrow_schema(schema), [f.name for f in schema.fields[:-2]]

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("child")
        gap = gaps(unit_rows(left.column("vec")), unit_rows(right.column("pivot")))
        at = gap.argmin(axis=1)
        child = right.column("child").to_numpy()[at]
        return pa.table([*[left.column(n) for n in names], pa.array(child), pa.array(gap[np.arange(len(at)), at])], schema=arrow)

    return _met(rows, pivots, rows_per_task, choose, schema)


class PivotTree:
    """``leaves``: base rows with their ``cell``; ``levels``: split regions with their children's pivots."""

    def __init__(self, base: DataFrame, leaf_rows: int, rows_per_task: int) -> None:
        self.rows_per_task = rows_per_task
        self.levels: list[DataFrame] = []
        self.leaves: DataFrame | None = None
        rows = base.withColumn("cell", F.lit(0).cast("long"))
        for _ in range(LEVELS):
            counts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.exists("vec", lambda x: x != 0)).alias("directed"))
            large = materialize(counts.where((F.col("n") > leaf_rows) & (F.col("directed") > 1)).select("cell"), "large")
            if large.isEmpty():
                break
            active = materialize(rows.join(large, "cell", "left_semi").select(*rows.columns), "region")
            self._keep(rows.join(large, "cell", "left_anti").select(*rows.columns))
            nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
            picked = active.where(F.exists("vec", lambda x: x != 0)).withColumn("nth", nth).where(F.col("nth") <= BRANCH)
            unknown = [F.lit(None).cast(t).alias(c) for c, t in (("radius", "double"), ("first", "long"), ("only", "string"))]
            child = (F.col("cell") * BRANCH + F.col("nth")).alias("child")
            picked = materialize(picked.select("cell", child, F.col("vec").alias("pivot"), *unknown), "pivots")
            rows = materialize(_to_nearest(active, picked, rows_per_task), "placed")
            stats = rows.groupBy(F.col("cell").alias("child")).agg(
                F.max("reach").alias("radius"), F.min("earlier").alias("first"),
                F.when(F.min("differ") == F.max("differ"), F.min("differ")).alias("only"),
            )
            self.levels.append(materialize(picked.select("cell", "child", "pivot").join(stats, "child").select(*_PIVOT), "level"))
            rows = rows.drop("reach")
        self._keep(rows)
        self.leaves = materialize(self.leaves, "leaves")

    def _keep(self, rows: DataFrame) -> None:
        self.leaves = rows if self.leaves is None else self.leaves.unionByName(rows)

    def _down(self, queries: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], written: list[DataFrame]) -> DataFrame:
        """Rows of ``queries`` (with ``cell``) taken from the root to leaves by ``step``; ``written`` gets the tables they are read from."""
        done = None
        for level in self.levels:
            split = level.select("cell").distinct()
            here = queries.join(split, "cell", "left_anti").select(*queries.columns)
            done = here if done is None else done.unionByName(here)
            queries = materialize(step(queries.join(split, "cell", "left_semi").select(*queries.columns), level), "down")
            written.append(queries)
        return queries if done is None else done.unionByName(queries)

    def homes(self, queries: DataFrame) -> DataFrame:
        """Queries with the ``cell`` of the leaf they fall into."""
        start = queries.withColumn("cell", F.lit(0).cast("long"))
        return self._down(start, lambda q, level: _to_nearest(q, level, self.rows_per_task).drop("reach"), [])

    def visits(self, queries: DataFrame, flags: tuple[bool, bool, bool], written: list[DataFrame] | None = None) -> DataFrame:
        """Queries (with ``bound``, the distance of their k-th neighbour so far) by each leaf that may improve on it.

        The leaf in ``home``, which was searched already, is left out. ``written`` gets the tables that the result is read from.
        """
        _, differ, earlier = flags
        start = queries.withColumn("cell", F.lit(0).cast("long"))
        schema = _columns(start)
        arrow, names = to_arrow_schema(schema), [f.name for f in schema.fields[:-1]]

        def choose(left: pa.Table, right: pa.Table) -> pa.Table:
            gap = gaps(unit_rows(left.column("vec")), unit_rows(right.column("pivot")))
            # cos distance d and Euclidean e of unit vectors: e = sqrt(2 d)
            bound = np.sqrt(2.0 * left.column("bound").to_numpy().astype(float)) + _TOLERANCE
            visit = gap - right.column("radius").to_numpy()[None, :] <= bound[:, None]
            if earlier:
                visit &= right.column("first").to_numpy()[None, :] < left.column("earlier").to_numpy()[:, None]
            if differ:
                only, mine = (np.array(t.column(c).to_pylist(), dtype=object) for t, c in ((right, "only"), (left, "differ")))
                visit &= ~((mine[:, None] == only[None, :]) & (only != None)[None, :])  # noqa: E711
            row, cell = np.nonzero(visit)
            picked = left.select(names).take(pa.array(row))
            return pa.table([*picked.columns, right.column("child").take(pa.array(cell))], schema=arrow)

        step = lambda q, level: _met(q, level, self.rows_per_task, choose, schema)
        found = self._down(start, step, [] if written is None else written)
        return found.where(F.col("cell") != F.col("home"))
