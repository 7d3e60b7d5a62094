"""The corpus pipeline on small tables with rows without an id and rows that repeat one."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n))


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_rows_without_or_with_a_repeated_id_are_judged_alone(spark, tmp_path):
    rng = random.Random(3)
    clean, again, plain = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    near = plain.split(" ")
    near[-1] = "changed"
    toxic = " ".join(["idiot moron scum"] * 20)
    rows = [(None, clean), (None, clean), (None, toxic), (None, plain), (None, " ".join(near)), (7, again), (7, toxic), (7, prose(rng, 5)), (-4, again)]
    docs = stored(spark, tmp_path, [(i, t, None, "a", len(t)) for i, t in rows])
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    kept = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert kept[None, clean] == 1 and not any(t == toxic for _, t in kept)
    assert kept[None, plain] + kept[None, " ".join(near)] == 1
    assert kept[-4, again] == 1 and kept[7, rows[7][1]] == 1 and sum(kept.values()) == 4
    mixed = corpus_pipeline.mixed_sources(spark, docs, str(tmp_path))
    assert mixed.groupBy("row_key").count().agg({"count": "max"}).first()[0] <= 3 and mixed.count() <= 12


def test_run_follows_the_curriculum(spark, tmp_path):
    """All documents differ and none is toxic, so mixing and packing are redone here for all rows."""
    rng = random.Random(4)
    data = [(i if i % 9 else None, prose(rng, rng.randint(1, 400) + 1500 * (i % 20 == 0)), None, "abc"[min(2, i // 6)], 0) for i in range(60)]
    stored(spark, tmp_path, data)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {s: sum(len(r[1].split()) for r in data if r[3] == s) for s in "abc"}
    capped, weight = set(), {"a": 1, "b": 2, "c": 3}
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in "abc" if s not in capped)
        more = {s for s in "abc" if s not in capped and 3 * size[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    expected = collections.Counter()
    for s, slope in zip("abc", (-0.5, 0.0, 0.5)):
        quota = 3 * size[s] if s in capped else math.floor(level * weight[s] + 0.5)
        own = sorted((r for r in data if r[3] == s), key=lambda r: md5(f"{'' if r[0] is None else r[0]}|{md5(r[1])}"))
        at, copy = 0, 0
        while at < quota:
            for doc_id, text, *_ in own:
                words = text.split()[: quota - at]
                if words:
                    share = at / quota
                    time = share if not slope else (math.sqrt((1 - slope) ** 2 + 4 * slope * share) - (1 - slope)) / (2 * slope)
                    ids = [*library.encode(" ".join(words), add_special_tokens=False).ids, 2]
                    first = (len(ids) - 1) % 1024 + 1
                    for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
                        part = ids[start : start + (1024 if piece else first)]
                        expected[doc_id, copy, round(time, 9), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
                at += len(words)
            copy += 1
    assert collections.Counter((r.doc_id, r.copy, round(r.position, 9), r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert max(r.copy for r in got) > 0 and len({(r.row_key, r.copy, r.piece) for r in got}) == len(got)
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length, r.position))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= 1024
    starts = [min(p[2] for p in filled[k]) for k in sorted(filled)]
    assert starts == sorted(starts)


def test_columns_named_like_those_of_the_stages_stay_apart(spark, tmp_path):
    """Also that a user's ``row_key`` is no key, and that tables without rows give none."""
    rng = random.Random(5)
    clean = [prose(rng, 30) for _ in range(5)]
    rows = [(i, t, None, "a", len(t), "same", -1, -2.0, "w", "d") for i, t in enumerate([*clean, clean[0]])]
    schema = SCHEMA + ", row_key string, copy int, position double, words string, _dropped string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "stage")
    got = docs.collect()
    assert {(r.doc_id, r.text) for r in got} == set(enumerate(clean)) and len(got) == 5
    assert all((r.row_key, r.copy, r.position, r.words, r._dropped) == ("same", -1, -2.0, "w", "d") for r in got)
    placed = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in placed) == [0, 1, 2, 3, 4] and {r.copy for r in placed} == {0}
    empty = tmp_path / "empty"
    empty.mkdir()
    stored(spark, empty, [])
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
