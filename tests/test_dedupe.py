import random

import pytest

from factloom.operators import dedupe
from factloom.operators.dedupe import dedupe_facts, leader_clusters

SCHEMA = "doc_id string, seq long, subject string, evidence_span string, confidence double"


def overlap(a, b):
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    s, t = set(a.split()), set(b.split())
    jac = 1.0 if not s and not t else len(s & t) / len(s | t)
    return jac >= 0.8 or a in b or b in a


def greedy(rows):
    blocks, leader = {}, {}
    for doc, seq, subject, span, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        heads = blocks.setdefault((doc, subject.strip().lower()), [])
        for s, text in heads:
            if overlap(text, span):
                leader[doc, seq] = s
                break
        else:
            heads.append((seq, span))
            leader[doc, seq] = seq
    return leader


def random_rows(seed, n, blanks=False):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "a", "be"]
    rows = []
    for i in range(n):
        span = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.2:
            span = span[rng.randint(0, 2) :]
        if rng.random() < 0.2 and rows:
            span = rng.choice(rows)[3].upper().replace(" ", "  ")
        if blanks and rng.random() < 0.02:
            span = "  "
        rows.append((f"d{rng.randint(0, 2)}", i, rng.choice(["Acme ", "acme", "Zed"]), span, rng.choice([0.5, 0.9])))
    return rows


@pytest.mark.parametrize("limit", [10_000, 1])
@pytest.mark.parametrize("seed,blanks", [(1, False), (2, True)])
def test_both_paths_equal_the_greedy_order(spark, limit, seed, blanks):
    rows = random_rows(seed, 160, blanks)
    got = leader_clusters(spark.createDataFrame(rows, SCHEMA), block_limit=limit).collect()
    assert {(r.doc_id, r.seq): r.leader for r in got} == greedy(rows)


def test_examples(spark):
    def kept(rows):
        out = dedupe_facts(spark.createDataFrame(rows, SCHEMA))
        return [r.seq for r in out.orderBy("seq").collect()]

    span = "Revenue was 8,142 crore in FY24"
    assert kept([("d", 0, "Co", span, 0.7), ("d", 1, "co ", span.upper(), 0.9)]) == [1]
    assert kept([("d", 0, "Co", span, 0.9), ("d", 1, "co", span, 0.9)]) == [0]
    assert kept([("d", 0, "Co", span, 0.9), ("d", 1, "Other", span, 0.9)]) == [0, 1]
    assert kept([("d", 0, "Co", "one thing", 0.9), ("d", 1, "Co", "quite another", 0.9)]) == [0, 1]
    assert kept([("d", 0, "Co", "was 8,142", 0.6), ("d", 1, "Co", "Revenue was 8,142", 0.85)]) == [1]
    assert kept([("d", 0, "Co", span, 0.9), ("e", 0, "Co", span, 0.9)]) == [0, 0]


def test_one_hot_block_of_copies(spark):
    rows = [("d", i, "Co", f"value {i % 7} of the year" if i % 3 else "the same span", 0.5) for i in range(3000)]
    got = leader_clusters(spark.createDataFrame(rows, SCHEMA), block_limit=4).collect()
    assert {(r.doc_id, r.seq): r.leader for r in got} == greedy(rows)


@pytest.mark.parametrize("part_pairs", [4_000_000, 3, 0])
def test_large_blocks_in_parts_and_rounds_equal_the_greedy_order(spark, monkeypatch, part_pairs):
    monkeypatch.setattr(dedupe, "PART_PAIRS", part_pairs)
    monkeypatch.setattr(dedupe, "DENSE_ROUNDS", 1)
    rows = random_rows(5, 140)
    got = leader_clusters(spark.createDataFrame(rows, SCHEMA), block_limit=1).collect()
    assert {(r.doc_id, r.seq): r.leader for r in got} == greedy(rows)


def test_a_long_chain_takes_a_fixed_number_of_jobs(spark):
    """Span i overlaps its neighbours only: every second one leads, however long the chain is."""

    def chain(n):
        spans = [" ".join(f"w{i + j}" for j in range(10)) for i in range(n)]
        return [("d", i, "Co", span, 0.5) for i, span in enumerate(spans)]

    def jobs(n):
        group = f"chain-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            frame = leader_clusters(spark.createDataFrame(chain(n), SCHEMA), block_limit=4)
            leaders = {r.seq: r.leader for r in frame.select("seq", "leader").collect()}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert leaders == {i: i - i % 2 for i in range(n)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert abs(jobs(10_000) - jobs(300)) <= 8
