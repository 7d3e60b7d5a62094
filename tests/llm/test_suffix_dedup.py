"""Removal of repeated passages against a count of all strings."""

import collections
import hashlib
import random

import numpy as np
import pytest

from factloom.llm import suffix_dedup as module
from factloom.llm.suffix_dedup import cover, dedup_passages

SCHEMA = "doc_id long, text string, u1 string, gram int, runs string, n_bytes int"


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), text in zip(rows, texts, strict=True):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)
    got = dedup_passages(df, length).collect()
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans) for r in got)
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)

    def noise(n, letters="abcdefghijklmnop é"):
        return "".join(rng.choice(letters) for _ in range(n))

    common, base = noise(90), noise(300)
    texts = [None, "", "short", common, base, base, base[:150] + "X" + base[151:], base[5:], base + base[:39], base + base[:40]]
    texts += [noise(rng.randint(0, 80)) + common + noise(rng.randint(0, 80)) for _ in range(40)]  # a third share one passage
    texts += [common[:39] + noise(30), common[:40] + noise(30), noise(30) + common[-41:], common[20:61], "a" * 39, "a" * 40, "b" * 41]
    texts += ["ab" * 60, "ba" * 30, " " * 200, noise(50, "ab"), noise(300, "a b"), "é" * 30, "xé" * 25 + "y"]
    for k in range(12):  # near copies, each with another byte changed
        texts.append(base[: 20 * k] + chr(65 + k) + base[20 * k + 1 :])
    texts += [noise(4000) + common + noise(500)]
    out = list(enumerate(texts))
    return out + [(4, base), (None, "no id " + base[:60]), (None, common[10:70]), (3, noise(70)), (700, noise(45)), (700, noise(45))]


@pytest.mark.parametrize("length", [40, 120])
def test_removal_equals_a_plain_count(spark, rows, length):
    assert run(spark, rows, length) == plain(rows, length)


def test_slices_and_flushes_change_nothing(spark, rows, monkeypatch):
    for name, value in (("GRAM", 8), ("SLICE", 150), ("FLUSH", 60), ("BUCKET_ROWS", 50), ("HOT_GRAM", 3), ("HOT_CORE", 4), ("BLOCK", 7), ("BROADCAST_KEYS", 5)):
        monkeypatch.setattr(module, name, value)
    assert run(spark, rows, 40) == plain(rows, 40)


def test_awkward_tables(spark):
    assert run(spark, [], 10) == []
    same = [(1, "x" * 25), (1, "x" * 25), (2, None)]
    assert run(spark, same, 10) == plain(same, 10)
    assert run(spark, [(1, "0123456789" * 2)], 10) == plain([(1, "0123456789" * 2)], 10)


def test_samples_are_dense_and_agree_on_equal_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[3000:3400] = data[500:900]
    hashes = module.gram_hashes(data, 16)
    places = cover(hashes, 85)
    at = np.arange(len(places))
    assert ((places >= at) & (places < at + 85)).all()
    assert all(hashes[p] >> np.uint64(13) == (hashes[i : i + 85] >> np.uint64(13)).min() for i, p in enumerate(places))
    assert (places[500:801] - 500 == places[3000:3301] - 3000).all()
