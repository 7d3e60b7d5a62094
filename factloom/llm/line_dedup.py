"""Line dedup by an exact set-similarity join.

The tokens of a line are its runs of ``width`` words. In one order of all tokens, the frequent ones last,
two similar lines share a token in their prefixes. Lines that do are compared if their sizes (length
filter) and the places of the shared token (positional filter) allow enough common tokens; whole sets are
verified, and of two similar lines the later one is removed. The earliest line of a token comes first:
lines it removes need no other partner, so a group of near copies costs one comparison for each line.
Sketches of about four bits a token pass nearly none but similar pairs, so few whole sets are made and moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.common import id_and_text, released
from factloom.llm.jaccard_join import SEEN, STEP, bitmap_of, passes
from factloom.llm.shingles import set_nodes, shingle_tables
from factloom.session import discard, materialize

#: Tokens that come last in the order, at most; a bound on what is broadcast.
FREQUENT = 200_000
#: Tokens up to which a filter is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Lines of one token that are compared in one piece; more are cut in blocks that meet in pairs.
LEAF = 256
#: Tokens counted at a time in a task, and the least count that is passed on.
FLUSH, LEAST = 2_000_000, 3
WIDTH = 5
#: Shares of the tokens that are shuffled one after another.
PARTS = 4
#: Pairs whose whole sets are shuffled at a time, up to so many shares, as each reads the sets once.
SHARE_PAIRS, SHARES = 500_000, 16
#: A line's number times this, with the hash of its document, is the key of the line.
_STRIDE = 0x9E3779B1


def _lines(batch: pa.RecordBatch, column: int) -> tuple[list[int], list[int], list[bytes]]:
    """Row, number and bytes of each line; null texts have none."""
    rows, numbers, lines = [], [], []
    for i, text in enumerate(batch.column(column).cast(pa.binary()).to_pylist()):
        if text is not None:
            own = text.split(b"\n")
            rows += [i] * len(own)
            numbers += range(len(own))
            lines += own
    return rows, numbers, lines


def frequent_tokens(docs: DataFrame, size: int = FREQUENT, width: int = WIDTH) -> np.ndarray:
    """Frequent tokens, rarest first, at most ``size``; every line is counted, chance hits drop out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flushed():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

        for batch in batches:
            for values, _ in shingle_tables(_lines(batch, 0)[2], width):
                held.append(values)
                total += len(values)
                if total > FLUSH:
                    yield flushed()
                    held, total = [], 0
        if held:
            yield flushed()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where("n >= 8").orderBy(F.desc("n"), "token").limit(size).toPandas()
    return top["token"].to_numpy(np.int64)[::-1].view(np.uint64).copy()


def _bitmaps(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit word for each set: every token flips one of its bits."""
    starts = np.r_[0, ends[:-1]]
    full = np.flatnonzero(ends > starts)
    words = np.zeros(len(ends), np.uint64)
    if len(full):
        words[full] = np.bitwise_xor.reduceat(np.uint64(1) << (values >> np.uint64(58)), starts[full])
    return words.view(np.int64)


def _sketches(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A bitmap for each set, at least 64 bits and 4 to 8 bits a token: every token flips one of its bits.

    Lengths are powers of two, and the two halves of a bitmap, combined by exclusive or, are one of half the length.
    """
    n = np.diff(ends, prepend=0)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64))
    until = np.cumsum(width)
    at = (values >> np.uint64(20)).astype(np.int64) & (np.repeat(width, n) - 1)
    odd = np.bincount(np.repeat(until - width, n) + at, minlength=until[-1] if len(until) else 0) & 1
    offsets = np.r_[0, until // 8].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])


def _apart(one: pa.Array, other: pa.Array) -> np.ndarray:
    """Bits in which the sketches of each pair differ, the longer one folded to the length of the shorter."""
    sides = [x.to_pylist() for x in (one, other)]
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    out = np.zeros(len(one), np.int64)
    for a, b in np.unique(np.c_[sizes[0], sizes[1]], axis=0) if len(one) else ():
        at = np.flatnonzero((sizes[0] == a) & (sizes[1] == b))
        width = min(a, b) // 8
        folded = []
        for side in sides:
            words = np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1, width)
            folded.append(np.bitwise_xor.reduce(words, axis=1))
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1)
    return out


def described(docs: DataFrame, frequent: np.ndarray, num: int, den: int, width: int = WIDTH) -> DataFrame:
    """``doc_id, line_no, node, n, bits, sketch, prefix`` of each line; lines of equal token sets have one ``node``."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            rows, numbers, lines = _lines(batch, 1)
            nodes, sizes, bits, sketches, prefixes, kept = [], [], [], [], [], []
            for values, ends in shingle_tables(lines, width):
                n = np.diff(ends, prepend=0)
                nodes.append(set_nodes(values, ends))
                sizes.append(n)
                bits.append(_bitmaps(values, ends))
                sketches.append(_sketches(values, ends))
                owner = np.repeat(np.arange(len(ends)), n)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                    rank = np.where(keys[at] == values, ranks[at] + 1, 0)
                    if rank.any():
                        values = values[np.lexsort((values, rank, owner))]
                reach = np.where(n > 0, n + (-num * n // den) + 1, 0)
                place = np.arange(len(values)) - np.repeat(ends - n, n)
                prefixes.append(values[place < reach[owner]])
                kept.append(reach)
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            node = pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64), mask=n == 0)
            until = np.r_[0, np.cumsum(np.concatenate(kept))] if kept else np.zeros(1, np.int64)
            items = (np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)).view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), node,
                 pa.array(n, pa.int32()), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)),
                 pa.concat_arrays(sketches) if sketches else pa.array([], pa.binary()), prefix],
                names=["doc_id", "line_no", "node", "n", "bits", "sketch", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"doc_id {kind}, line_no int, node long, n int, bits long, sketch binary, prefix array<long>")


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where its row count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _near(pairs: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """The (later, earlier) pairs whose sketches allow that they are similar.

    Each bit in which two sketches differ stands for a token that only one of the lines has.
    """

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("l_n").to_numpy().astype(np.int64) + batch.column("e_n").to_numpy()
            apart = _apart(batch.column("l_sketch"), batch.column("e_sketch"))
            fits = (total - apart) * (num + den) >= 2 * num * total
            yield batch.select(["later", "earlier"]).filter(pa.array(fits))

    held = firsts.select("node", "n", "sketch")
    both = pairs.join(held.toDF("later", "l_n", "l_sketch"), "later").join(held.toDF("earlier", "e_n", "e_sketch"), "earlier")
    return both.mapInArrow(sieve, "later long, earlier long")


def _line_key(doc_id: str, line_no: str) -> Column:
    return F.xxhash64(doc_id).bitwiseXOR(F.col(line_no).cast("long") * F.lit(_STRIDE))


def _whole_sets(docs: DataFrame, width: int, firsts: DataFrame) -> DataFrame:
    """``node, items`` of the nodes in ``firsts`` and of few others, from their first lines.

    A bitmap of fixed size, of the keys of these lines, picks the lines that are cut into tokens.
    """
    keys = firsts.select(_line_key("first.doc_id", "first.line_no").alias("node"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            rows, numbers, lines = _lines(batch, 1)
            key = batch.column(0).to_numpy()[np.array(rows, np.int64)] ^ (np.array(numbers, np.int64) * _STRIDE)
            picked = [lines[i] for i in np.flatnonzero(passes(bits, key)).tolist()]
            for values, ends in shingle_tables(picked, width):
                starts = np.r_[0, ends[:-1]]
                node = set_nodes(values, ends)
                fresh = [i for i in np.flatnonzero(ends > starts).tolist() if not (node[i] in seen or seen.add(node[i]))]
                if len(seen) > SEEN:
                    seen.clear()
                if fresh:
                    items = pa.array([values[starts[i] : ends[i]].view(np.int64) for i in fresh], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), items], names=["node", "items"])
        released()

    sets = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(emit, "node long, items array<long>")
    return sets.groupBy("node").agg(F.min("items").alias("items"))


def _verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """The (later, earlier) pairs whose whole token sets are similar, written."""
    near = materialize(_near(pairs, firsts, num, den), "near")
    ends = near.select(F.explode(F.array("later", "earlier")).alias("node")).distinct()
    sets = materialize(_whole_sets(docs, width, firsts.join(ends, "node", "left_semi")), "sets")
    common = F.size(F.array_intersect("l_items", "e_items"))
    is_similar = common * den >= (F.size("l_items") + F.size("e_items") - common) * num
    shares = min(SHARES, max(1, -(-near.count() // SHARE_PAIRS)))
    similar = []
    for n in range(shares):
        share = near.where(F.pmod(F.xxhash64("later"), F.lit(shares)) == n)
        both = share.join(sets.toDF("later", "l_items"), "later").join(sets.toDF("earlier", "e_items"), "earlier")
        similar.append(materialize(both.where(is_similar).select("later", "earlier"), "similar"))
    discard(near, sets)
    return reduce(DataFrame.unionByName, similar)


def _open_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (later, earlier) candidates: open lines of each token against all earlier ones."""
    sizes = rows.groupBy("token").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "token")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(task.alias("task"), "node", "n", "bits", "place", "open", "block", "other", F.col("first.doc_id").alias("doc"), F.col("first.line_no").alias("line"))
    tasks = max(1, rows.count() // 50_000)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["task", "doc", "line"], kind="stable")
        task = frame["task"].to_numpy()
        new = np.r_[True, task[1:] != task[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(frame)), 0))
        node, n, bits, place, block, other = (frame[c].to_numpy(np.int64) for c in ("node", "n", "bits", "place", "block", "other"))
        later = np.flatnonzero(frame["open"].to_numpy(bool))
        until = np.cumsum(later - first[later])
        out, at = [], 0
        # Open lines against all before them in their task, about STEP pairs at a time.
        while at < len(later):
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + STEP)))
            rows = later[at:stop]
            own = rows - first[rows]
            i = np.repeat(rows, own)
            j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[rows], own)
            at = stop
            # Two lines of one block meet in the task of that block alone.
            met = (block[i] != block[j]) | (block[i] == other[i])
            i, j = i[met], j[met]
            total = n[i] + n[j]
            least = -(-num * total // (num + den))
            # Common tokens lie before both places or from both places on.
            room = np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j])
            apart = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64)
            fits = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (room >= least) & (total - apart >= 2 * least)
            out.append(np.c_[node[i[fits]], node[j[fits]]])
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["later", "earlier"])

    bucket = F.pmod(F.col("task"), F.lit(tasks)).alias("bucket")
    return dealt.groupBy(bucket).applyInPandas(compare, "later long, earlier long").distinct()


def _members(firsts: DataFrame, part: int, num: int, den: int) -> DataFrame:
    """Lines of the shared tokens of one of ``PARTS`` shares, with the earliest line of their token as ``head``.

    Lines and heads come from one shuffle. Tokens of one line only end here. ``fits`` marks pairs that pass the
    length, the positional and the bitmap filter, which alone are verified. One order of tokens holds for both
    lines, so common ones are before both places or from both places on. Each bit in which two bitmaps differ
    stands for a token that only one of the lines has.
    """
    cells = firsts.select("node", "first", "n", "bits", F.posexplode("prefix").alias("place", "token"))
    cells = cells.where(F.pmod("token", F.lit(PARTS)) == part)
    token = Window.partitionBy("token")
    turn = token.orderBy("first", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.first(F.struct("node", "n", "bits", "place")).over(turn)
    members = cells.select("*", head.alias("head"), F.count("*").over(token).alias("size")).where("size > 1")
    sizes = F.least("n", "head.n") * den >= F.greatest("n", "head.n") * num
    room = F.least(F.col("n") - F.col("place"), F.col("head.n") - F.col("head.place")) + F.least("place", "head.place")
    total = F.col("n") + F.col("head.n")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("head.bits")))
    fits = sizes & (room * (num + den) >= total * num) & ((total - apart) * (num + den) >= total * (2 * num))
    members = members.withColumn("fits", fits).withColumn("head", F.col("head.node"))
    return members.where("size > 2 or (fits and node != head)")


def dedup_lines(
    docs: DataFrame, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """``doc_id, line_no, n_tokens, kept`` for each line (text between line feeds) of each row.

    A line is removed if an earlier one, by id and then number, has ``den * common >= num * joint`` tokens,
    whether that one stays or not. A line of fewer than ``width`` words is one token; lines without words stay.
    Null texts have no lines, an empty text has one. Rows that repeat an id share their line numbers, and
    lines of equal id, number and tokens are one line. Null ids come last. An empty table gives no rows.
    Tokens are compared by 64-bit hashes. A very long text is cut into its lines, a very long line is one set.
    """
    docs = id_and_text(docs, id_col, text_col)
    wide = materialize(described(docs, frequent_tokens(docs, width=width), num, den, width), "described")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no")
    # Lines of equal token sets are one node from here on, so that copies of a line cost nothing further.
    firsts = wide.where("node is not null").groupBy("node").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("n", "bits", "sketch", "prefix")])
    firsts = materialize(firsts, "firsts")
    lines = materialize(wide.select("doc_id", "line_no", "node", "n"), "lines")
    discard(wide)
    # Shared tokens grow with the corpus, so their lines meet in a shuffle at every size: a share of the tokens after another,
    # as what a share was shuffled for leaves the disk before the next.
    members = [materialize(_members(firsts, part, num, den), "members") for part in range(PARTS)]
    written, members = members, reduce(DataFrame.unionByName, members)
    pairs = members.where("fits and node != head").select(F.col("node").alias("later"), F.col("head").alias("earlier"))
    pairs = materialize(pairs.distinct(), "pairs")
    similar = _verified(docs, pairs, firsts, num, den, width)
    removed = materialize(similar.select(F.col("later").alias("node")).distinct(), "removed")
    discard(pairs, similar)
    # Lines still open meet the other earlier lines of their tokens; two lines of one token have met already.
    gone, rest = _few(removed).withColumn("_gone", F.lit(True)), []
    for part in written:
        marked = part.where("size > 2").join(gone, "node", "left")
        marked = marked.withColumn("open", F.col("_gone").isNull() & (F.col("node") != F.col("head"))).drop("_gone", "head", "fits", "size")
        marked = materialize(marked, "marked")
        discard(part)
        alive = materialize(marked.where("open").select("token").distinct(), "alive")
        rest.append(materialize(_open_pairs(marked.join(_few(alive), "token", "left_semi"), num, den), "rest"))
        discard(marked, alive)
    apart, rest = rest, materialize(reduce(DataFrame.unionByName, rest).distinct(), "rest")
    discard(*apart)
    more = _verified(docs, rest, firsts, num, den, width).select(F.col("later").alias("node"))
    gone = removed.unionByName(more).distinct().withColumn("_gone", F.lit(True))
    judged = firsts.select("node", "first").join(gone, "node", "left")
    judged = materialize(judged.select(F.col("node").alias("_node"), F.col("first").alias("_first"), F.col("_gone").isNull().alias("_stays")), "judged")
    discard(firsts, rest)
    judged = lines.join(judged, lines["node"] == F.col("_node"), "left")
    stays = F.col("_stays") & (F.col("_first") == order)
    return judged.select("doc_id", "line_no", F.col("n").alias("n_tokens"), F.when(F.col("node").isNull(), True).otherwise(F.coalesce(stays, F.lit(False))).alias("kept"))
