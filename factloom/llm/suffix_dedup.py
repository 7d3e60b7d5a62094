"""Removal of repeated passages by a blockwise suffix sort over a cover sample.

Two suffixes that agree on ``length`` bytes must be found wherever they start. A cover sample makes that
cheap: from every run of ``length`` bytes one position is sampled, at the same distance in equal runs (the
content-defined form of a difference cover, a string synchronising set). Sampled positions are sorted in
buckets by their first bytes and ranked by all bytes around them: suffixes before positions of equal rank
are equal, so long ties are settled by the rank and never compared again. Only suffixes that a rank leaves
open, and whose sample starts like another one, are compared themselves: again in buckets, by a core that
neighbouring suffixes share and the few bytes beside it. One bucket is sorted at a time, and nothing but
buckets of a set size is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text
from factloom.llm.shingles import mixed
from factloom.session import materialize

#: Bytes that a sampled position is chosen and first compared by.
GRAM = 96
#: Bytes of text that one step of a task looks at; a longer text is cut, with an overlap of ``length``.
SLICE = 1 << 20
#: Entries aimed at in one bucket, and entries that a task combines before it sends them.
BUCKET_ROWS, FLUSH = 1 << 17, 1 << 18
#: Ranks of one gram that a task sends to its bucket; a gram with more is known to be shared.
HOT_GRAM = 64
#: Neighbouring suffixes that are compared by one core, and cores more frequent than this go another way.
BLOCK, HOT_CORE = 32, 50_000
#: Keys of texts that are broadcast to pick texts before a shuffle; beyond, all texts are shuffled.
BROADCAST_KEYS = 1_000_000

_random = np.random.default_rng(77)
_BYTES = _random.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

_UNIT = "u1 long, u2 int"
_KEY = ["u1", "u2"]
SETTLED, ALONE, PARTNER, MET, MARKER = range(5)
_RUN = np.dtype(
    [("gram", "<i8"), ("r1", "<i8"), ("r2", "<i4"), ("u1", "<i8"), ("u2", "<i4"), ("start", "<i4"), ("n", "<i4"), ("lead", "<i4"), ("kind", "<i4")]
)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE)], dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all ``width`` bytes in a row; they choose and group samples, no result rests on them."""
    up, down = _Powers.of(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)]
    n = len(data) - width + 1
    return mixed((sums[width:] - sums[:n]) * down[:n])


def cover(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` grams the place of its least hash, the leftmost of equal ones."""
    bits = np.uint64(int(len(hashes)).bit_length())
    n = len(hashes) - window + 1
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    rows = np.full(-(-len(keys) // window) * window, ~np.uint64(0))
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[window - 1 : window - 1 + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs_of(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts that share their sample: first start, number of starts, sample, and hash of its gram.

    ``valid`` marks the starts whose ``length`` bytes lie in one text.
    """
    hashes = gram_hashes(data, gram)
    sample = cover(hashes, length - gram + 1)
    starts = np.flatnonzero(valid[: len(sample)])
    own = sample[starts]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(own) else own
    counts = np.diff(np.r_[first, len(own)])
    return starts[first], counts, own[first], hashes[own[first]]


def _slices(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, its place, bytes): groups of whole short texts, or slices of a long one; every start is in one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SLICE):
            part = text[at : at + SLICE + length - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time become Python objects, whatever the size of Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield batch.slice(at, 128)


def _equal(rows: np.ndarray, *names: str) -> np.ndarray:
    """Numbers of the groups of neighbouring rows that agree in ``names``."""
    new = np.zeros(len(rows), bool)
    for name in names:
        new[1:] |= rows[name][1:] != rows[name][:-1]
    return np.cumsum(new)


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by gram and rank, the number of each row's rank, and whether that rank was met twice."""
    rows = rows[np.lexsort((rows["start"], rows["u2"], rows["u1"], rows["r2"], rows["r1"], rows["gram"]))]
    rank = _equal(rows, "gram", "r1", "r2")
    twice = np.bincount(rank, rows["kind"] == MET) + np.bincount(rank) > 1 if len(rows) else np.zeros(0, bool)
    return rows, rank, twice[rank] if len(rows) else twice


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)


def _as_kind(rows: np.ndarray, kind: int) -> np.ndarray:
    rows = rows.copy()
    rows["kind"] = kind
    return rows


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries for the buckets, decisions) of one task's runs.

    Of runs of equal rank one is sent, marked as met; the others are settled. A gram with many ranks is
    shared for certain: its runs are left open at once, and a marker tells its bucket.
    """
    rows, rank, met = _ranked(rows)
    first = _firsts(rank)
    decided = [_as_kind(rows[~first], SETTLED)]
    sent, met = rows[first], met[first]
    sent["kind"] = np.where(met, MET, ALONE)
    gram = _equal(sent, "gram")
    hot = np.bincount(gram)[gram] > HOT_GRAM if len(sent) else np.zeros(0, bool)
    decided += [_as_kind(sent[hot & ~met], ALONE), _as_kind(sent[hot & met], SETTLED), _as_kind(sent[hot & met], PARTNER)]
    marks = _as_kind(sent[hot & _firsts(gram)], MARKER)
    return np.concatenate([sent[~hot], marks]), np.concatenate(decided)


def decided(rows: np.ndarray) -> np.ndarray:
    """Decisions on one bucket's entries: settled runs, open runs, and partners of open ones."""
    marks = np.unique(rows["gram"][rows["kind"] == MARKER])
    rows, rank, met = _ranked(rows[rows["kind"] != MARKER])
    if not len(rows):
        return rows
    first = _firsts(rank)
    gram = _equal(rows, "gram")
    marked = np.isin(rows["gram"], marks)
    several = (np.bincount(gram, first)[gram] > 1) | marked
    alone = (np.bincount(gram, first & ~met)[gram] > 0) | marked
    return np.concatenate(
        [_as_kind(rows[met], SETTLED), _as_kind(rows[~met & several], ALONE), _as_kind(rows[met & first & several & alone], PARTNER)]
    )


def cover_decisions(docs: DataFrame, length: int, gram: int, n_bytes: int) -> DataFrame:
    """``kind, u1, u2, start, n, lead``: what the cover sample's ranks say about each run of suffixes.

    The rank of a sample is a digest of all bytes that its run's strings cover, so equal ranks mean that all
    strings of the two runs are equal, start by start. SETTLED runs repeat. ALONE runs have a rank of their
    own, but their sample's gram is shared; PARTNERs stand for the repeated ranks of such grams. Runs whose
    gram occurs nowhere else cannot repeat and are left out.
    """
    buckets = max(1, -(-2 * n_bytes // (max(2, length - gram) * BUCKET_ROWS)))
    packed = pa.schema([("bucket", pa.int64()), ("rows", pa.binary())])

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        sent, done = combined(np.concatenate(held))
        bucket = (sent["gram"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, sent = bucket[order], sent[order]
        cuts = np.flatnonzero(_firsts(bucket))
        numbers, parts = bucket[cuts].tolist(), [sent[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(sent)], strict=True)]
        # Decisions pass through in pieces, dealt to groups of their own.
        for at in range(0, len(done), BUCKET_ROWS):
            numbers.append(-1 - int(done["r1"][at].view(np.uint64) % np.uint64(buckets)))
            parts.append(done[at : at + BUCKET_ROWS].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())], schema=packed)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _small(batches):
            units = [batch.column(i).to_numpy() for i in (0, 1)]
            for group in _slices(_texts(batch.column(2)), length):
                sizes = np.array([len(p) for _, _, p in group])
                ends = np.cumsum(sizes)
                joined = b"".join(p for _, _, p in group)
                valid = np.ones(len(joined), bool)
                for end in ends:
                    valid[end - length + 1 : end] = False
                starts, counts, samples, grams = runs_of(np.frombuffer(joined, np.uint8), valid, length, gram)
                rank = [hashlib.blake2b(joined[s : s + n + length - 1], digest_size=12).digest() for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                rank = np.frombuffer(b"".join(rank), np.dtype([("r1", "<i8"), ("r2", "<i4")]))
                part = np.searchsorted(ends, starts, side="right")
                text = np.array([i for i, _, _ in group])[part]
                rows = np.zeros(len(starts), _RUN)
                rows["gram"], rows["r1"], rows["r2"], rows["u1"], rows["u2"] = grams.view(np.int64), rank["r1"], rank["r2"], units[0][text], units[1][text]
                rows["start"] = starts - (ends - sizes)[part] + np.array([at for _, at, _ in group])[part]
                rows["n"], rows["lead"] = counts, samples - starts
                held.append(rows)
                size += len(rows)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, _RUN) for b in table["rows"].to_pylist()])
        rows = decided(rows) if key[0].as_py() >= 0 else rows
        return pa.table({c: rows[c] for c in ("kind", "u1", "u2", "start", "n", "lead")})

    dealt = docs.select("u1", "u2", "text").mapInArrow(find, "bucket long, rows binary")
    return dealt.groupBy("bucket").applyInArrow(decide, f"kind int, {_UNIT}, start int, n int, lead int")


def blocks_of(text: bytes, start: int, n: int, lead: int, length: int, block: int) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """(core, bytes beside it, first, number, base) for the suffixes of one run, ``block`` at a time.

    Blocks are counted from the sample, so that equal runs are cut alike. All suffixes ``base + t`` of a block
    contain its core; the one at ``t`` continues it by ``beside[t : t + block - 1]``. Bytes outside the text
    are zeros, which no suffix in it reaches.
    """
    sample = start + lead
    for j in range((lead - n + 1) // block, lead // block + 1):
        base = sample - block * j - block + 1
        first, last = max(start, base), min(start + n, base + block)
        left = text[max(0, base) : base + block - 1].rjust(block - 1, b"\0")
        right = text[base + length : base + length + block - 1].ljust(block - 1, b"\0")
        yield text[base + block - 1 : base + length], left + right, first - base, last - first, base


def _equal_windows(rows: list[tuple], block: int) -> Iterator[tuple[int, int, int, int]]:
    """``u1, u2, start, n`` of the repeated suffixes among blocks of one core (beside, first, n, base, u1, u2, alone)."""
    seen: dict[tuple[int, bytes], int] = {}
    met = [set() for _ in rows]
    for i, (beside, first, n, *_) in enumerate(rows):
        for t in range(first, first + n):
            other = seen.setdefault((t, beside[t : t + block - 1]), i)
            if other != i:
                met[i].add(t)
                met[other].add(t)
    for (_, first, n, base, u1, u2, alone), places in zip(rows, met, strict=True):
        if alone and places:
            t, end = first, first + n
            while t < end:
                stop = t
                while stop < end and stop in places:
                    stop += 1
                if stop > t:
                    yield u1, u2, base + t, stop - t
                t = stop + 1


def repeated_suffixes(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """``u1, u2, start, n``: of the suffixes of open runs those that agree with another on ``length`` bytes."""
    block = min(BLOCK, length)
    by_text = open_runs.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n", "lead", "kind")).alias("runs"))
    by_text = materialize(by_text, "open")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out: list[tuple] = []
            for u1, u2, text, runs in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3))), strict=True):
                for run in runs:
                    for core, beside, *place in blocks_of(text, run["start"], run["n"], run["lead"], length, block):
                        c = hashlib.blake2b(core, digest_size=16).digest()
                        out.append((int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), beside, *place, u1, u2, run["kind"] == ALONE))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    long, small = pa.int64(), pa.int32()
    fields = pa.schema([("c1", long), ("c2", long), ("beside", pa.binary()), ("first", small), ("n", small), ("base", small), ("u1", long), ("u2", small), ("alone", pa.bool_())])
    schema = f"c1 long, c2 long, beside binary, first int, n int, base int, {_UNIT}, alone boolean"
    met = _only(docs.select(*_KEY, "text"), by_text).join(by_text, _KEY)
    blocks = materialize(met.select(*_KEY, "text", "runs").mapInArrow(cut, schema), "blocks")
    cores = blocks.groupBy("c1", "c2").agg(F.count("*").alias("times"), F.count_if("alone").alias("open")).where("times > 1 and open > 0")
    cores = materialize(cores, "cores")
    total = cores.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_ROWS))

    def sort_bucket(table: pa.Table) -> pa.Table:
        order = table.sort_by([("c1", "ascending"), ("c2", "ascending")])
        c1, c2 = (order[c].to_numpy() for c in ("c1", "c2"))
        cuts = np.flatnonzero(np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
        found: list[tuple] = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(c1)], strict=True):
            part = order.slice(a, b - a)
            rows = list(zip(*(part[c].to_pylist() for c in ("beside", "first", "n", "base", "u1", "u2", "alone")), strict=True))
            found += _equal_windows(rows, block)
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = (long, small, small, small)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["u1", "u2", "start", "n"])

    usual = blocks.join(cores.where(F.col("times") <= HOT_CORE).select("c1", "c2"), ["c1", "c2"], "left_semi")
    usual = usual.withColumn("bucket", F.pmod("c1", F.lit(buckets))).groupBy("bucket").applyInArrow(sort_bucket, f"{_UNIT}, start int, n int")
    # A core in very many blocks: its suffixes become rows, which meet by all their bytes.
    hot = blocks.join(cores.where(F.col("times") > HOT_CORE).select("c1", "c2"), ["c1", "c2"], "left_semi")
    hot = hot.withColumn("t", F.explode(F.expr("sequence(first, first + n - 1)")))
    hot = hot.withColumn("own", F.expr(f"substring(beside, t + 1, {block - 1})"))
    keys = ["c1", "c2", "t", "own"]
    often = hot.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1").select(*keys)
    hot = hot.where("alone").join(often, keys, "left_semi").select(*_KEY, (F.col("base") + F.col("t")).alias("start"), F.lit(1).alias("n"))
    return usual.unionByName(hot)


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is ``wanted``, before their texts are shuffled, if the keys are few."""
    if wanted.count() > BROADCAST_KEYS:
        return docs
    return docs.join(F.broadcast(wanted.select(*_KEY)), _KEY, "left_semi")


def merged_spans(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes (start, end) that the strings of these runs of starts cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order].astype(np.int64), np.maximum.accumulate((starts + counts)[order].astype(np.int64) + length - 1)
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return np.c_[starts[new], ends[np.r_[new[1:] - 1, len(ends) - 1]]]


def dedup_passages(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``, one row for each row of ``docs``.

    Every byte that a string of ``length`` bytes covers is removed if that string also starts anywhere else,
    in this text or another. Strings are judged on the input; overlapping occurrences count; matches never
    cross texts. ``n_spans`` counts the maximal removed runs and ``spans`` has their ``start`` and ``end``.

    Null text counts as empty, and a text shorter than ``length`` loses nothing. Of equal texts each loses
    everything that is long enough, repeated rows included, as each string starts in the other too. Ids may
    be null or repeated: a row is known by id and text. Long texts are worked on in slices. An empty table
    gives no rows; other columns are not read.
    """
    gram = min(GRAM, length)
    docs = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("u1", F.xxhash64("doc_id", "text")).withColumn("u2", F.hash("text", "doc_id"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    told = materialize(cover_decisions(docs.where(F.octet_length("text") >= length), length, gram, n_bytes), "decisions")
    settled = told.where(F.col("kind") == SETTLED).select(*_KEY, "start", "n")
    repeated = settled.unionByName(repeated_suffixes(docs, told.where(F.col("kind") != SETTLED), length))
    by_text = repeated.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            found = [merged_spans(r.values.field("start").to_numpy(), r.values.field("n").to_numpy(), length) for r in batch.column(2)]
            removed = pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in found], pa.int64())
            edges = pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in found], span_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), removed, edges], names=["u1", "u2", "n_removed", "spans"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            hashes = []
            for text, edges in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                sha, at = hashlib.sha256(), 0
                for edge in edges:
                    sha.update(text[at : edge["start"]])
                    at = edge["end"]
                sha.update(text[at:])
                hashes.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(hashes, pa.string())], names=["doc_id", "spans", "n_bytes", "n_removed", "kept_sha256"])

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    spanned = "spans array<struct<start: long, end: long>>"
    gone = materialize(by_text.mapInArrow(spans, f"{_UNIT}, n_removed long, {spanned}"), "spans")
    few = gone.count() <= BROADCAST_KEYS
    removed = gone.select(*_KEY, "n_removed")
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long")).join(F.broadcast(removed) if few else removed, _KEY, "left")
    cut = F.coalesce(F.col("n_removed") < F.col("n_bytes"), F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Only texts that keep a part meet their spans; the others are decided without.
    parts = docs.where(cut).join(gone.select(*_KEY, "spans"), _KEY).select("doc_id", "text", "spans", "n_bytes", "n_removed")
    parts = parts.mapInArrow(keep, f"doc_id {kind}, {spanned}, n_bytes long, n_removed long, kept_sha256 string")
    none = F.col("n_removed").isNull()
    whole = docs.where(~cut).select(
        "doc_id", F.when(none, F.expr("cast(array() as array<struct<start: long, end: long>>)"))
        .otherwise(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).alias("spans"),
        "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.sha2(F.when(none, F.col("text")).otherwise(F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
    found = parts.unionByName(whole)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
