"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration says how many pieces of each length fill one sequence. Multiplicative weights price the
lengths that are behind their demand, a knapsack over the capacity finds the best configuration at these
prices, and the fractional use of configurations is rounded down; best fit on the counts of lengths packs
what rounding leaves. Only the histogram, at most one number for each length, leaves Spark.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text, ranked, spread_key, with_running_sum
from factloom.session import materialize

CAPACITY = 1024
END = 2
#: Most rounds of the program, the share of a length's demand that one may meet, and how fast prices fall.
ROUNDS, STEP, RATE = 1500, 0.25, 1.0
#: Room that a configuration of the program may leave; the others are filled anew.
SLACK = 1
#: Share of the fractional solution that is rounded; the rest leaves best fit some of every length.
KEPT = 0.5
#: Parts of the training time that use the configurations in equal shares, where pieces have a time.
EPOCHS = 64
#: Chunks of text remembered by a Python worker, and the longest one worth remembering.
REMEMBERED, LONGEST = 700_000, 48


class ByteTokens(dict):
    """Ids of " " + chunk as little-endian bytes, remembered by chunk.

    The tokenizer's file gives vocabulary, merges and added tokens. Where the merges are in the order of
    the ids, as in byte-level vocabularies grown by merging, ids are ranks and ``tiktoken`` can apply them.
    """

    def __init__(self, tokenizer_file: str):
        import json

        import regex
        import tiktoken

        super().__init__()
        with open(tokenizer_file, encoding="utf-8") as f:
            plan = json.load(f)
        before, model = plan["pre_tokenizer"], plan["model"]
        if plan["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only a plain byte-level tokenizer is supported")
        # Printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.added = {t["content"]: t["id"] for t in plan["added_tokens"]}
        vocabulary = {p: i for p, i in model["vocab"].items() if p not in self.added}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the merges are not in the order of the ids")
        ranks = {bytes(byte_of[c] for c in p): i for p, i in vocabulary.items()}
        # Fixed value: the pattern of byte-level pre-tokenizers.
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("file", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self.added_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.blanks, self.long_blanks, self.words = regex.compile(r"\s\s"), regex.compile(r"\s{512}"), regex.compile(words)

    def _slow(self, text: str) -> bytes:
        if len(text) >= 512 and self.long_blanks.search(text):
            # The library's own matcher has no stack for long white space.
            ids = [i for word in self.words.findall(text) for i in self.encoding._encode_single_piece(word)]
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self._slow(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        # Without two white-space characters in a row no word crosses a blank, so chunks are independent.
        if self.blanks.search(text):
            return self._slow(text)
        chunks = text.split(" ")
        return self._slow(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))

    def encode(self, text: str) -> bytes:
        if self.added_at is None or not any(t in text for t in self.added):
            return self._plain(text)
        parts = [np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.added_at.split(text)]
        return b"".join(parts)


@lru_cache(2)
def byte_tokens(tokenizer_file: str) -> ByteTokens:
    """One per Python worker, so that its memory of chunks serves all its tasks."""
    return ByteTokens(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and the columns ``more``: the ids of each text and the end id, cut where too long.

    All pieces but the first of a cut document hold ``capacity`` ids. Null text counts as empty: one piece
    with the end id.
    """
    docs = id_and_text(docs, id_col, text_col, *more)
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(tokenizer_file)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = tokens.encode(text or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    size = first if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *[c.take(at) for c in batch.columns[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *more],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{carried}")


def _best(prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the configuration of the highest total price; ``prices[l]`` is that of length l."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        sums = prices[1 : room + 1] + value[room - 1 :: -1][:room]
        best = room - 1 - int(sums[::-1].argmax())  # of equal prices the longest piece, short ones are easy to place later
        if sums[best] > value[room - 1]:
            value[room], choice[room] = sums[best], best + 1
        else:
            value[room] = value[room - 1]
    config, room = {}, capacity
    while room > 0:
        if choice[room]:
            config[int(choice[room])] = config.get(int(choice[room]), 0) + 1
            room -= int(choice[room])
        else:
            room -= 1
    return config


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences are kept once, with their number."""
    open_at: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, config: tuple[tuple[int, int], ...], n: int) -> None:
        if room not in open_at:
            open_at[room] = []
            bisect.insort(rooms, room)
        open_at[room].append((config, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                config, held = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[i]
                per = min(room // length, n)
                if per > 1 and held * per > n:
                    per = max(1, n // held)
                full = min(held, n // per)
                put(room - per * length, (*config, (length, per)), full)
                if held > full:
                    put(room, config, held - full)
                n -= full * per
            else:
                per = min(capacity // length, n)
                put(capacity - per * length, ((length, per),), n // per)
                n %= per
    merged: dict[tuple[tuple[int, int], ...], int] = {}
    for configs in open_at.values():
        for config, n in configs:
            parts: dict[int, int] = {}
            for length, k in config:
                parts[length] = parts.get(length, 0) + k
            key = tuple(sorted(parts.items()))
            merged[key] = merged.get(key, 0) + n
    return [(dict(key), n) for key, n in sorted(merged.items())]


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) that together hold exactly the pieces of the histogram."""
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    used: list[tuple[dict[int, int], int]] = []
    if demand[capacity]:
        used.append(({capacity: 1}, int(demand[capacity])))
    left = demand.copy()
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        bins = max(1, int(np.ceil((lengths * left[lengths]).sum() / capacity)))
        weight = lengths * left[lengths] / (lengths * left[lengths]).sum()
        covered, total = np.zeros(len(lengths)), 0.0
        place = {int(n): i for i, n in enumerate(lengths)}
        mixed: dict[tuple[tuple[int, int], ...], float] = {}
        for _ in range(rounds):
            if total >= bins:
                break
            prices = np.full(capacity + 1, -1.0)
            prices[lengths] = np.where(covered < 1, weight / left[lengths], 0.0)
            config = _best(prices, capacity)
            if not config:
                break
            # So little that no length gets far ahead of the others.
            step = STEP * min(left[n] / k for n, k in config.items())
            total += step
            key = tuple(sorted(config.items()))
            mixed[key] = mixed.get(key, 0.0) + step
            for n, k in config.items():
                i = place[n]
                covered[i] += k * step / left[n]
                weight[i] *= np.exp(-RATE * k * step / left[n])
        # Rounding: whole sequences, never more than the demand, and none with room that a length could fill.
        for key, amount in sorted(mixed.items(), key=lambda kv: (-kv[1], kv[0])):
            if capacity - sum(n * k for n, k in key) > SLACK:
                continue
            times = int(min([KEPT * amount, *(left[n] // k for n, k in key)]))
            if times:
                used.append((dict(key), times))
                for n, k in key:
                    left[n] -= k * times
        used += _best_fit(left, capacity)
    return used


def _by_epoch(used: list[tuple[dict[int, int], int]]) -> Iterator[tuple[dict[int, int], int]]:
    """The same sequences, those of each configuration spread over the epochs."""
    for epoch in range(EPOCHS):
        for i, (config, times) in enumerate(used):
            phase = i * 37 % EPOCHS
            n = ((epoch + 1) * times + phase) // EPOCHS - (epoch * times + phase) // EPOCHS
            if n:
                yield config, n


def pack(
    cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, keys: tuple[str, ...] = ("doc_id", "piece"), time: str | None = None
) -> DataFrame:
    """Add ``sequence_id, offset`` to the rows of :func:`pieces`; each sequence is filled from 0 without gaps.

    Pieces of one length are interchangeable; a fixed pseudo-random order deals them to configurations,
    by the columns ``keys``, so reruns agree and repeated rows get places of their own. With a column ``time`` of values in
    [0, 1], pieces of one length are dealt by it, and sequences are numbered by the least time of their pieces. An empty table gives no rows.
    """
    digest = spread_key(*keys)
    if time is not None:
        place = (F.least(F.greatest(F.col(time), F.lit(0.0)), F.lit(1 - 2.0**-52)) * 2.0**52).cast("long")
        digest = F.concat(F.lower(F.lpad(F.hex(place), 13, "0")), digest)
    cut = materialize(cut.withColumn("digest", digest), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    used = configurations(histogram, capacity, rounds)
    taken: dict[int, int] = {}
    table, base = [], 0  # (length, first rank, first sequence, pieces per sequence, first offset)
    for config, times in used if time is None else _by_epoch(used):
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            rank = taken.get(length, 0)
            table.append((length, rank, base, n, offset))
            taken[length] = rank + n * times
            offset += n * length
        base += times
    layout = np.array(sorted(table), np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(layout)
    numbered = with_running_sum(cut, ["length"], "digest", F.lit(1), "rank", *keys, "ids_crc32", rows=sum(histogram.values()))
    numbered = numbered.drop("digest")
    width = len(numbered.columns)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        keys = own[:, 0] << np.int64(48) | own[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = own[np.searchsorted(keys, length << np.int64(48) | rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 2] + nth // at[:, 3], at[:, 4] + nth % at[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: width - 1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[: width - 1], "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1])
    placed = numbered.mapInArrow(put, f"{kinds}, sequence_id long, offset long")
    if time is None:
        return placed
    placed = materialize(placed, "placed")
    starts = placed.groupBy("sequence_id").agg(F.min(time).alias("_at"))
    numbers = ranked(starts, F.struct("_at", "sequence_id"), "_number").select("sequence_id", "_number")
    columns = [F.col("_number").alias(c) if c == "sequence_id" else F.col(c) for c in placed.columns]
    return placed.join(numbers, "sequence_id").select(*columns)
