"""Hard negatives against a plain search in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hard_negatives as module
from factloom.llm.hard_negatives import hard_negatives, products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, _asks string, slot int, nth int"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        one[i] = min(one.get(i, (label, whole)), (label, whole))
    out = set()
    for a, (label, v) in one.items():
        if a % 10:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in one.items() if i != a and len(w) == len(v)]
        liked = sorted((s, i) for s, i, other in scores if other == label)[:positives]
        for s, p in liked:
            fit = sorted((n, i) for n, i, other in scores if other != label and low * -s <= 100 * -n <= high * -s)
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fit[:negatives], 1)}
    return out


def run(spark, rows, **kind):
    data = [(i, v, label, "s", "t", 0, 0) for i, v, label in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = [tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, **kind).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = []
    for i in range(260):
        label = 0 if rng.random() < 0.4 else rng.randrange(4)
        mix = rng.random()
        v = [float(np.float32(mix * c + (1 - mix) * d + rng.gauss(0, 0.3))) for c, d in zip(centres[label], centres[(label + 1) % 4], strict=True)]
        out.append((i, v, label))
    hot = out[7][1]  # a vector that a third of all rows share
    out += [(300 + i, hot, i % 3) for i in range(130)]
    out += [
        (500, None, 1), (501, [1.0] * 6, None), (None, [1.0] * 6, 1), (503, [1.0, None] * 3, 1), (504, [float("nan")] * 6, 1),
        (505, [float("inf")] * 6, 1), (510, [0.0] * 6, 1), (511, [], 1), (520, [], 2), (530, [1.0, 2.0], 1), (531, [2.0, 2.0], 1),
        (532, [1.0, 1.0], 2), (540, [1.0] * 6, 9), out[10], out[20], (540, [2.0] * 6, 9), (-10, out[3][1], 0),
    ]
    return out


def test_negatives_equal_a_plain_search(spark, rows, monkeypatch):
    assert run(spark, rows) == plain(rows)
    monkeypatch.setattr(module, "ANCHOR_BLOCK", 20)
    monkeypatch.setattr(module, "ROW_BLOCK", 60)
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, positives=3, negatives=4, low=10, high=100) == plain(rows, 3, 4, 10, 100)


def test_awkward_tables(spark, rows):
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()  # no anchor
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == set()  # no negative
    same = [(i, [1.0, 1.0], i % 2) for i in range(40)]  # every score is a tie, none in a window
    assert run(spark, same) == plain(same) == set()
    assert run(spark, same, high=100) == plain(same, high=100) != set()


def test_products_stay_exact():
    a = np.array([[2**40, -(2**40) + 1], [3, 4]])
    b = np.array([[2**21 + 1, 5], [2**62, 2**62]])
    assert products(a, b)[0, 0] == 2**40 * (2**21 + 1) + 5 * (1 - 2**40)
    assert products(a, b)[1, 1] == 2**63 - 1 and products(a[1:], b[:1])[0, 0] == 3 * (2**21 + 1) + 20
