"""Large searches take shares of the queries one after another, and vectors keep their precision; results are the same."""

import numpy as np
import pytest

from factloom.operators import nearest


@pytest.fixture(scope="module")
def rows(spark):
    vectors = np.random.default_rng(11).normal(size=(300, 6)).astype(np.float32)
    data = [(i, [float(x) for x in v], f"g{i % 5}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "id long, embedding array<float>, grp string").cache()


@pytest.mark.parametrize(("copies", "search"), [
    (400, lambda r: nearest.nearest_join(r, r, 4, differ="grp", earlier="id")),
    (3000, lambda r: nearest.nearest_join(r, r, 4, cells=6, rows_per_task=40)),
    (500, lambda r: nearest.nearest_join(r, r, 4, cells=6, probes=2)),
    (2000, lambda r: nearest.lsh_join(r, r, 4)),
])
def test_shares_of_the_queries_change_nothing(rows, monkeypatch, copies, search):
    whole = sorted(map(tuple, search(rows).collect()))
    written, usual = [], nearest.materialize

    def watched(df, name):
        written.append((name, df.schema))
        return usual(df, name)

    monkeypatch.setattr(nearest, "SHARE_COPIES", copies)
    monkeypatch.setattr(nearest, "materialize", watched)
    assert sorted(map(tuple, search(rows).collect())) == whole and whole
    assert sum(name == "share" for name, _ in written) > 1
    kinds = {s["vec"].dataType.simpleString() for _, s in written if "vec" in s.names}
    assert kinds == {"array<float>"}
