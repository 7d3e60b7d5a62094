"""The search by random projections scores buckets in slices and ranks by the distance of the exact search."""

import numpy as np

from factloom.operators.nearest import lsh_join, nearest_join


def test_one_bucket_for_all_gives_the_exact_result(spark):
    """Also for a zero vector, at distance 1 from all, and for copies of a vector."""
    rng = np.random.default_rng(7)
    vectors = np.abs(rng.normal(size=(120, 6)))
    vectors[5] = 0.0
    vectors[20:40] = vectors[19]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    rows = lambda found: {(r.query_id, r.rank): (r.base_id, round(r.distance, 8)) for r in found.collect()}
    assert rows(lsh_join(df, df, 4, bucket=50.0)) == rows(nearest_join(df, df, 4))
