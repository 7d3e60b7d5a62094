"""Sketches bound the difference of two sets of tokens; whole sets are made for few but similar lines."""

import random

import numpy as np

from factloom.llm import line_dedup


def test_sketches_bound_the_difference_at_every_length():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 15, 16, 17, 40, 200, 1000]
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    sets += [np.unique(np.r_[s[: len(s) - len(s) // 8], rng.integers(0, 2**63, len(s) // 8).astype(np.uint64)]) for s in sets]
    sketches = line_dedup._sketches(np.concatenate(sets), np.cumsum([len(s) for s in sets]))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = line_dedup._apart(sketches.take(i), sketches.take(j))
    for a, b, bits in zip(i, j, apart, strict=True):
        difference = len(np.setxor1d(sets[a], sets[b]))
        assert bits <= difference and (bits - difference) % 2 == 0
        assert a != b or bits == 0
    assert apart[7 * len(sets) + 15] > 100  # an eighth of 1,000 tokens differs, twice


def test_only_lines_that_can_be_similar_are_made_into_sets(spark, monkeypatch):
    rng = random.Random(5)
    shared = [f"s{i} s{i}x" for i in range(60)]
    lines = [" ".join([f"own{i}x{k}" for k in range(60)] + rng.sample(shared, 50)) for i in range(40)]
    lines += [line + " more" for line in lines[:3]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    made, whole = [], line_dedup._whole_sets

    def watched(docs, width, firsts):
        made.append(firsts.count())
        return whole(docs, width, firsts)

    monkeypatch.setattr(line_dedup, "_whole_sets", watched)
    monkeypatch.setattr(line_dedup, "SHARE_PAIRS", 1)
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs, width=1).collect() if r.kept}
    assert kept == set(range(40))
    assert sum(made) == 6
