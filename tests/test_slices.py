"""Slices of the nearest join grow with the table: a row is not shuffled more often in a larger one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import nearest


def test_copies_of_a_row_do_not_grow_with_the_table(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(nearest, "TASKS", 16)
    for n in (256, 1024):
        rng = np.random.default_rng(n)
        vectors = rng.normal(size=(n, 4))
        rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")
        found = nearest.nearest_join(rows, rows, 3, rows_per_task=8)
        one = rows.select(F.lit(0).alias("cell"), "id", F.col("embedding").alias("vec"), F.lit("").alias("match"), F.lit("").alias("differ"), F.lit(0).cast("long").alias("earlier"))
        other = one.select(*[F.col(c).alias(c) for c in one.columns])
        parts = nearest._score_cells(one, other, 3, 8, (False, False, False), 1)
        # Each slice of the base gives its best to every query.
        sent.append(parts.count() / (3 * n))
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = np.round(1 - unit @ unit.T, 9) + 0.0
        want = {(q, b) for q in range(n) for b in np.lexsort((np.arange(n), near[q]))[:3].tolist()}
        assert {(r.query_id, r.base_id) for r in found.collect()} == want
    assert sent[0] <= 5 and sent[1] <= 5
