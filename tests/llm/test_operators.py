"""Each operator against a plain version, on a small table with every awkward kind of row."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id, secrets as scan, toxicity
from factloom.llm.common import ranked, with_running_sum
from factloom.llm.exact_dedup import CountingQuotientFilter, exact_duplicates
from factloom.llm.jaccard_join import jaccard_join
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.mixing import mix, training_order
from factloom.llm.neighbours import hilbert_keys, nearest
from factloom.llm.packing import ByteTokens, configurations, pack, pieces
from factloom.llm.queries import LLM_QUERIES
from factloom.llm.shingles import shingle_sets
from factloom.llm.token_counts import PieceMerger, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, size int, node string, _total int, score string"
BLANK = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))

    texts = [None, "", " ", "\t \n", "one", "One", "two words", "  lead and trail ", "lead and trail", " lead  and trail ", "日本 ñandú 😀\xa0x"]
    base = prose(120)
    texts += [base, base, base.replace(" ", "\n"), base.replace(" ", "  ")]
    for k in range(12):  # near copies in a chain
        changed = base.split(" ")
        changed[7 * k : 7 * k + 1 + k % 4] = [f"new{k}"]
        texts.append(" ".join(changed))
    shared = prose(60)
    texts += [prose(80) + " " + shared + " " + prose(80) for _ in range(10)]
    texts += [prose(rng.randint(1, 300)) for _ in range(60)]
    texts += ["x " * 3000 + prose(9000), "a" * 30000, " " * 5000 + "end", "<|endoftext|> <s> </s> <unk> ▁ ▁▁"]
    out = [(i, t, None, rng.choice(["a", "a", "a", "b", None]), i, "n", 0, "s") for i, t in enumerate(texts)]
    out.append(out[11])  # a repeated row
    out.append((None, "without an id", None, "c", 0, "n", 0, "s"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_running_sums_and_ranks(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "cold", None]), hashlib.md5(str(i).encode()).hexdigest(), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, d string, v int")
    got = {(r.g, r.d): r.before for r in with_running_sum(df, ["g"], "d", F.col("v"), "before", rows=5_000_000).collect()}
    for group in ("hot", "cold", None):
        total = 0
        for _, d, v in sorted((r for r in data if r[0] == group), key=lambda r: r[1]):
            assert got[group, d] == total
            total += v
    placed = ranked(df.select("d"), F.col("d"), "place").collect()
    assert [r.d for r in sorted(placed, key=lambda r: r.place)] == sorted(d for _, d, _ in data)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 500).astype(np.uint64)
    prints[:200] = prints[200:400]
    prints[-3:] = [0, 2**64 - 1, 0]
    parts = [CountingQuotientFilter.of(p, np.ones(len(p), np.int64), 12) for p in np.array_split(prints, 7)]
    whole = CountingQuotientFilter.merged(parts)
    assert dict(zip(whole.prints().tolist(), whole.counts.tolist())) == collections.Counter(prints.tolist())


@pytest.mark.parametrize("seed", range(6))
def test_quotient_filters_hold_crowded_slots(seed):
    rng = np.random.default_rng(seed)
    prints = rng.integers(0, 2**64, 400, np.uint64)
    prints[:150] = (prints[:150] >> np.uint64(50)) | np.uint64(2**64 - 2**14)  # one quotient at the end
    prints[150:220] >>= np.uint64(40 + seed)
    whole = CountingQuotientFilter.merged(CountingQuotientFilter.of(p, np.ones(len(p), np.int64)) for p in np.array_split(prints, 9))
    expected = collections.Counter(prints.tolist())
    assert whole.prints().tolist() == sorted(expected) and whole.counts.tolist() == [expected[p] for p in sorted(expected)]
    for range_bits in (0, 1, 7):
        read = [(p, n) for f in whole.pieces(range_bits) for p, n in zip(f.prints().tolist(), f.counts.tolist())]
        assert read == sorted(expected.items())
        assert all(f.prints().tolist() == f.with_(CountingQuotientFilter.of(prints[:0], np.zeros(0, np.int64))).prints().tolist() for f in whole.pieces(range_bits))
    assert CountingQuotientFilter.merged([]) is None
    # An entry sits in its quotient's slot or behind it, without an empty slot between.
    used = np.flatnonzero(whole.marks)
    home = (whole.prints() >> np.uint64(64 - whole.bits)).astype(np.int64)
    assert (home <= used).all() and ((whole.marks[used] & whole.SHIFTED > 0) == (home < used)).all()


def test_quotient_filters_of_many_batches_take_about_linear_time():
    rng, moved = np.random.default_rng(1), []
    laid_out = CountingQuotientFilter.laid_out.__func__

    class Counted(CountingQuotientFilter):
        @classmethod
        def laid_out(cls, prints, *more):
            moved.append(len(prints))
            return laid_out(cls, prints, *more)

    for batches in (50, 200):
        moved.clear()
        Counted.merged(Counted.of(rng.integers(0, 2**64, 100, np.uint64), np.ones(100, np.int64)) for _ in range(batches))
        assert sum(moved) <= 100 * batches * (2 + batches.bit_length())


def test_exact_duplicates(docs, rows, empty):
    got = exact_duplicates(docs).collect()
    assert len(got) == len(rows) and exact_duplicates(empty).count() == 0
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(BLANK, " ", r[1] or "")].append(r[0])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    for digest in by_hash:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1


def test_mixing(docs, rows, empty):
    got = mix(docs).collect()
    assert mix(empty).count() == 0 and len(got) == len(rows)
    size = {r[0]: len(words_of(r[1])) for r in rows}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    totals = collections.Counter()
    for r in rows:
        totals[r[3]] += size[r[0]]
    names = sorted([s for s in totals if s is not None]) + [None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    whole, capped = sum(totals.values()), set()
    while True:
        left = whole - sum(3 * totals[s] for s in capped)
        level = left / sum(weights[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 3 * totals[s] < level * weights[s]}
        if not more:
            break
        capped |= more
    for s in names:
        target = 3 * totals[s] if s in capped else level * weights[s]
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == totals[s] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 1
    assert sorted(map(tuple, mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    order = training_order(mix(docs)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and all(0 <= r.position <= 1 for r in order)
    taken = collections.Counter()
    for r in order:
        taken[r.doc_id] += r.words
    for r in got:
        if r.doc_id != 11:  # its row is repeated
            assert taken[r.doc_id] == r.taken


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r[0]: r[1] or "" for r in rows}
    got = token_counts(docs, path, limit=50).collect()
    assert len(got) == len(rows) and token_counts(empty, path).count() == 0
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 50)
    merger, rng = PieceMerger(path), random.Random(2)
    letters = [" ", "  ", "\n", "\t", "a", "e", "th", "日", "ñ", "😀", "▁", "\x00", "<s>", "<0x0A>", "1", "."]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        assert merger.count(text) == len(library.encode(text)), repr(text)


def test_secrets(spark, empty):
    key = "AKIA" + "Q7" * 8
    texts = {
        0: None, 1: "", 2: f"password = 'hunter22' and token:abc then {key} é{'0af3' * 6}", 3: "token: token: abcdefgh",
        4: "secret=secret=abcdef; API_KEY=\"Xy-1234567\"", 5: "AKIASHORT AKIA" + "Z" * 15, 6: "deadbeef" * 2, 7: "ſecret=abcdefgh",
    }
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(16, 30))) for _ in range(300)]
    texts[8] = " ".join(words)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(rng.choice(alphabet) for _ in range(32)) + "7" for _ in range(20)]
    texts[9] = " ".join(strings) + " aaaaaaaaaaaaaaaa1111111111111111"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in scan.secrets(df).collect()}
    assert len(got) == len(texts) and scan.secrets(empty).count() == 0
    for doc_id, text in texts.items():
        found = []
        for kind, pattern, least, group in (
            (0, r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
            (1, r"AKIA[A-Z0-9]+", 20, 0), (2, r"[0-9a-f]+", 24, 0),
        ):
            found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        spans = ",".join(f"{scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in found) for i in range(3)]
        own = r.spans.split(",") if r.spans else []
        assert [s for s in own if not s.startswith("random")] == (spans.split(",") if spans else [])
    assert got[8].n_random == 0 and 15 <= got[9].n_random <= 20


def test_language_codes_and_predictions(spark, empty):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}
    data = []
    for i in range(240):
        lang = rng.choice(sorted(letters))
        data.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(rng.randint(1, 60))), lang))
    extra = [(900, None, "aa"), (901, "", None), (902, "12 345 !", "bb"), (903, "a", None), (904, "kl " * 40000, None)]
    df = spark.createDataFrame(data + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = language_id.remainder("doc_id", 4) == 2
    model = language_id.fit(df.where(~held))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got) == len(data) + len(extra)
    tested = [(i, lang) for i, _, lang in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in tested) >= 0.98 * len(tested)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[904].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    for n in (2, 3, 4, 6, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(row) for row in code}) == n and np.abs(code.sum(axis=0)).max() < n
    assert language_id.identify(empty, model).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(7)
    bad, vocabulary = ["grubnak", "fozzle", "skeevo"], ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(300)]
    data, marks = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        data.append((i, " ".join(words)))
        marks.append((i, toxic))
    data += [(900, None), (901, ""), (902, "you fоzzle " * 3), (903, "F0ZZLE, sk33vo! grubn​ak"), (904, "clean " * 30000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    held = language_id.remainder("doc_id", 5) == 0
    lexicon = toxicity.fit(df, labels.where(~held), exceptions=("harmless fozzle",))
    got = {r.doc_id: r for r in toxicity.toxicity(df, lexicon).collect()}
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    tested = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in tested) >= 0.97 * len(tested)
    assert [got[i].predicted for i in (900, 901, 902, 903, 904)] == [0, 0, 1, 1, 0]
    assert lexicon.score("a harmless fozzle") < 0.5 < lexicon.score("a fozzle")
    prior = toxicity.fit(empty, labels)
    assert prior.score("what an idiot") > prior.score("what a day") and toxicity.toxicity(empty, prior).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    cut = pieces(docs, path)
    got = pack(cut).collect()
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    counted = collections.Counter(r[0] for r in rows)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    for doc_id, n in counted.items():
        own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == doc_id)
        lengths = [x[2] for x in own[::n]]
        assert len(own) == n * len(lengths) and sum(lengths) == len(ids[doc_id])
        assert all(x == 1024 for x in lengths[1:]) and 1 <= lengths[0] <= 1024
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    rooms = []
    for length in sorted((r.length for r in got), reverse=True):  # plain best-fit decreasing
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(1024 - length)
    assert len(filled) <= 1.01 * len(rooms) + 1
    assert pack(pieces(empty, path)).count() == 0
    tokens, rng = ByteTokens(path), random.Random(3)
    letters = [" ", "  ", "\n", "a", "'s", "E", "日", "ñ", "😀", "\xa0", "　", "\x00", "<|endoftext|>", "1", "."]
    for text in ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(2000)] + [" " * 600 + "x"]:
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("histogram", [{}, {1024: 3}, {600: 50, 400: 50, 24: 50}, {1: 5000}, {i: 1 + i % 7 for i in range(1, 1024, 3)}])
def test_configurations_hold_the_histogram(histogram):
    used = configurations(dict(histogram))
    held = collections.Counter()
    for config, times in used:
        assert times > 0 and sum(n * k for n, k in config.items()) <= 1024
        for n, k in config.items():
            held[n] += k * times
    assert held == collections.Counter(histogram)
    total = sum(n * k for n, k in histogram.items())
    assert sum(t for _, t in used) <= 1.02 * total / 1024 + 1


def brute_components(rows, width, num, den):
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and den * common >= num * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((str(r[0]), len(sets[i]), str(r[0] if not sets[i] else least.get(find(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize("width,num,den,leaf", [(4, 85, 100, 256), (5, 8, 10, 4), (2, 6, 10, 3)])
def test_jaccard_join(docs, rows, empty, monkeypatch, width, num, den, leaf):
    monkeypatch.setattr("factloom.llm.jaccard_join.LEAF", leaf)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join(docs, width, num, den).collect())
    assert got == brute_components(rows, width, num, den)
    if leaf == 4:
        assert jaccard_join(empty).count() == 0


def test_jaccard_join_with_a_full_bitmap_and_short_counts(docs, rows, monkeypatch):
    monkeypatch.setattr("factloom.llm.jaccard_join.FILTER_WORDS", 1)
    monkeypatch.setattr("factloom.llm.jaccard_join.FLUSH", 500)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join(docs, 3, 7, 10).collect())
    assert got == brute_components(rows, 3, 7, 10)


@pytest.mark.parametrize("rows_limit,leaf", [(1_000_000, 256), (0, 3)])
def test_line_dedup(docs, rows, empty, monkeypatch, rows_limit, leaf):
    monkeypatch.setattr("factloom.llm.line_dedup.BROADCAST_ROWS", rows_limit)
    monkeypatch.setattr("factloom.llm.line_dedup.LEAF", leaf)
    got = collections.Counter((str(r.doc_id), r.line_no, r.n_tokens, r.kept) for r in dedup_lines(docs).collect())
    seen, expected = [], collections.Counter()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate((r[1]).split("\n") if r[1] is not None else []):
            w = words_of(line)
            own = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
            place = (str(r[0]), i)
            hit = own and any(p != place and 10 * len(own & s) >= 8 * len(own | s) for p, s in seen)
            expected[(*place, len(own), not hit)] += 1
            if own:
                seen.append((place, own))
    assert got == expected
    if leaf == 3:
        assert dedup_lines(empty).count() == 0


def test_line_dedup_query_takes_pairs_of_words(spark, docs, rows, tmp_path):
    near = "one changed word in a line of some twenty words must not save its near copy from being removed by the {} operator here"
    more = [(5000 + i, near.format(w), None, "a", 0, "n", 0, "s") for i, w in enumerate(("query", "whole"))]
    docs.unionByName(spark.createDataFrame(more, SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((str(r.doc_id), r.line_no, r.n_tokens, r.kept) for r in LLM_QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect())
    seen, expected = [], collections.Counter()
    for r in sorted([*rows, *more], key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate((r[1]).split("\n") if r[1] is not None else []):
            w = words_of(line)
            own = frozenset(zip(w, w[1:])) or (frozenset([tuple(w)]) if w else frozenset())
            place = (str(r[0]), i)
            hit = own and any(p != place and 10 * len(own & s) >= 8 * len(own | s) for p, s in seen)
            expected[(*place, len(own), not hit)] += 1
            if own:
                seen.append((place, own))
    assert got == expected
    assert [k[3] for k in sorted(got) if k[0] in ("5000", "5001")] == [True, False]


def test_shingles_do_not_depend_on_grouping():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(40))).encode() for _ in range(300)] + [None, b""]
    whole = [s.tolist() for s in shingle_sets(texts, 3)]
    assert whole == [next(shingle_sets([t], 3)).tolist() for t in texts]
    for text, own in zip(texts, whole, strict=True):
        w = (text or b"").split()
        assert len(own) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ([1] if w else []))


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(700, 16))
    points[200:320] = points[5]
    data = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    broken = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15),
              (1005, [1.0] * 3), (None, [1.0] * 16), data[40]]
    df = spark.createDataFrame(data + broken, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = total = 0
    for q in range(0, 700, 20):
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(700), far))[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == far[v] for _, v, s in own)
        assert own == sorted(own, key=lambda r: (r[2], r[1]))
        hits += len({v for _, v, _ in own} & set(best.tolist()))
        total += 10
    assert hits >= 0.9 * total and {r.query_id for r in got} == set(range(0, 700, 20))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest(few, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert nearest(few.limit(0), F.lit(True)).count() == 0
