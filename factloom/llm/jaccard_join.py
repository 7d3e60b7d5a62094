"""Exact Jaccard join of shingle sets as a metric-space join.

Jaccard distance is a metric. Documents lie at distance 1 from nearly all others, so document pivots
alone would replicate everything everywhere; the first pivots are single shingles, points of the same
space. In one fixed order of all shingles a document belongs to the cell of its first shingle, and the
triangle inequality says how many further cells its window reaches: two sets within the radius share one
of their first ``n - ceil(t n) + 1`` shingles. Inside a cell a document is the pivot. Documents within the
radius of it, its ball, are linked through it and need no comparison among themselves, so a group of copies
costs one distance for each member. By the triangle inequality only documents within two radii can have
neighbours in the ball: these meet the ball in a region of their own, and all outside the ball form another;
both are joined again in the same way. Small regions compare what is still apart: sketches of counted shingles
give lower bounds of the distance and name the members that may link, and these are compared on whole sets in
one task, which passes on only the links that merge components. All links are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text, released
from factloom.llm.shingles import mixed, set_nodes, shingle_sets, shingle_tables
from factloom.operators.clusters import components
from factloom.session import discard, materialize

#: Shingles that come last in the order, the most frequent first found ones; a bound on what is broadcast.
FREQUENT = 200_000
#: Least counters of a sketch; longer sets have a power of two of them, about one for 2 shingles.
SKETCH = 64
#: Members up to which a region is compared directly, and rounds of pivots before larger ones are cut in blocks.
LEAF, DEPTH = 256, 2
#: Pairs looked at in one step of a task, which bounds its memory.
STEP = 1_000_000
#: Words of 64 bits in the bitmap that picks sets ahead of a join: 4 MB at every size of the corpus.
FILTER_WORDS = 1 << 19
#: Nodes a task remembers to have sent.
SEEN = 200_000
#: Shingles counted at a time in a task, and the least count that is passed on.
FLUSH, LEAST = 1_000_000, 3


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def frequent_shingles(docs: DataFrame, width: int, size: int = FREQUENT) -> np.ndarray:
    """Frequent shingles, rarest first, at most ``size``: all documents are counted, chance hits drop out.

    They only set the order of shingles, which changes the work and never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flushed():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names=["key", "n"])

        for batch in batches:
            for own in shingle_sets(_texts(batch, 0), width):
                held.append(own)
                total += len(own)
                if total > FLUSH:
                    yield flushed()
                    held, total = [], 0
        if held:
            yield flushed()
        released()

    counts = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where("n >= 8").orderBy(F.desc("n"), "key").limit(size).toPandas()
    return top["key"].to_numpy(np.int64)[::-1].view(np.uint64).copy()


def described(docs: DataFrame, width: int, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """``doc_id, node, n, sketch, prefix``: equal sets have one 64-bit ``node``, null for the empty set."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            nodes, sizes, sketches, prefixes = [], [], [], []
            for own in shingle_sets(_texts(batch, 1), width):
                n = len(own)
                sizes.append(n)
                if not n:
                    nodes.append(None)
                    sketches.append(None)
                    prefixes.append(None)
                    continue
                nodes.append(int(mixed(mixed(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                sketches.append(sketch_of(own))
                reach = n + (-num * n // den) + 1
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = keys[at] == own
                    last = own[often][np.argsort(ranks[at[often]], kind="stable")]
                    first = np.r_[own[~often], last][:reach]
                else:
                    first = own[:reach]
                prefixes.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n", "sketch", "prefix"],
            )
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"doc_id {kind}, node long, n long, sketch binary, prefix array<long>")


def bitmap_of(nodes: DataFrame) -> np.ndarray:
    """Bits of the given nodes in a bitmap of fixed size; with many nodes it lets more of the others pass."""
    at, bit = F.col("node").bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("at"), F.expr("shiftleft(1L, int(shiftright(node, 40) & 63))").alias("bit")
    found = nodes.select(at, bit).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits


def passes(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bits of the nodes."""
    return (bits[nodes & (len(bits) - 1)] >> ((nodes >> 40) & 63)) & 1 == 1


def whole_sets(docs: DataFrame, width: int, nodes: DataFrame) -> DataFrame:
    """``node, items`` of the given nodes and of others that their bitmap lets pass, from the texts.

    A task sends a set once, however many copies it has.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(nodes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            for values, ends in shingle_tables(_texts(batch, 0), width):
                starts = np.r_[0, ends[:-1]]
                node = set_nodes(values, ends)
                hits = np.flatnonzero((ends > starts) & passes(bits, node))
                fresh = [i for i in hits.tolist() if not (node[i] in seen or seen.add(node[i]))]
                if len(seen) > SEEN:
                    seen.clear()
                items = pa.array([values[starts[i] : ends[i]].view(np.int64) for i in fresh], pa.list_(pa.int64()))
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), items], names=["node", "items"])
        released()

    sets = docs.select("text").mapInArrow(emit, "node long, items array<long>")
    return sets.groupBy("node").agg(F.min("items").alias("items"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``common, joint`` (sizes of intersection and union) to distinct (a, b) pairs."""
    left, right = sets.toDF("a", "a_items"), sets.toDF("b", "b_items")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    return both.select("a", "b", common.alias("common"), (F.size("a_items") + F.size("b_items") - common).alias("joint"))


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of regions that still hold two components, one of them with a home member."""
    held = rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sides = held.groupBy("region").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min(F.col("mask") % 2).alias("_home"))
    sides = sides.where("_low < _high and _home = 0").select("region")
    return held.join(materialize(sides, "apart"), "region", "left_semi")


def _heads(links: DataFrame) -> DataFrame:
    """``node, root``: the least node within two links; nodes of one root are in one component."""
    near = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
    near = materialize(near, "heads")
    further = near.select(F.col("node").alias("root"), F.col("root").alias("_further"))
    roots = materialize(near.join(further, "root", "left").select("node", F.coalesce("_further", "root").alias("root")), "roots")
    discard(near)
    return roots


def sketch_of(own: np.ndarray) -> bytes:
    """Counts of the shingles by hash; the difference of two sketches is at most that of the sets."""
    cells = max(SKETCH, 1 << (len(own) // 2).bit_length())
    counts = np.bincount((own >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _folded(sketch: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8).reshape(-1, cells).sum(axis=0, dtype=np.int32)


def _difference(a: bytes, b: bytes) -> int:
    cells = min(len(a), len(b))
    return int(np.abs(_folded(a, cells) - _folded(b, cells)).sum())


def _bounded(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Add ``maybe`` (the bounds allow a link) and ``low`` (a lower bound of the distance) to (a, b) pairs."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("a_n").to_numpy().astype(np.int64), batch.column("b_n").to_numpy().astype(np.int64)
            total = n[0] + n[1]
            gap = np.array([_difference(a, b) for a, b in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), strict=True)], np.int64)
            maybe = (den * np.minimum(*n) >= num * np.maximum(*n)) & (gap <= total - 2 * -(-num * total // (num + den)))
            low = 2 * gap / np.maximum(1, total + gap)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(maybe), pa.array(low)], names=["a", "b", "maybe", "low"])

    left, right = members.toDF("a", "a_n", "a_sketch"), members.toDF("b", "b_n", "b_sketch")
    return pairs.join(left, "a").join(right, "b").mapInArrow(bound, "a long, b long, maybe boolean, low double")


def _pairs_within(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs inside the runs, at most about STEP at a time."""
    rows = np.arange(starts[0], ends[-1]) if len(starts) else np.zeros(0, np.int64)
    partners = np.repeat(ends, ends - starts) - rows - 1
    until = np.cumsum(partners)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + STEP)))
        own = partners[at:stop]
        i = np.repeat(rows[at:stop], own)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        at = stop


def _suspects(rows: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """``task, node, root``: the members of each task that may link with a member of another component there.

    A large region is cut in blocks, and blocks meet in pairs, a task each. At most one row is made for a
    member of a task, however many partners it may have.
    """
    sizes = rows.groupBy("region").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("blocks"), F.min("node").alias("lead"))
    dealt = rows.join(sizes, "region").join(members, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = F.least("block", "other"), F.greatest("block", "other")
    # Regions with the same first member hold much the same pairs; they are dealt alike, so that a task sees these once.
    tasks = max(1, rows.count() // 40_000)
    bucket = F.pmod(F.xxhash64("lead", *ends), F.lit(tasks)).alias("bucket")
    dealt = dealt.select(bucket, F.xxhash64("region", *ends).alias("task"), "node", "root", "mask", "n", "sketch")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["task", "node"], kind="stable")
        task = frame["task"].to_numpy()
        starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        node, root, mask, n = (frame[c].to_numpy(np.int64) for c in ("node", "root", "mask", "n"))
        sketch = frame["sketch"].tolist()
        cells = np.array([len(s) for s in sketch])
        seen = np.zeros((0, 2), np.int64)
        kept = np.zeros(len(frame), bool)
        for i, j in _pairs_within(starts, np.r_[starts[1:], len(frame)]):
            fits = (root[i] != root[j]) & ((mask[i] & mask[j]) == 0) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            # Members are in order of node, so equal pairs of different regions look alike.
            _, first = np.unique(np.c_[node[i], node[j]], axis=0, return_index=True)
            i, j = i[first], j[first]
            total = n[i] + n[j]
            spare = total - 2 * -(-num * total // (num + den))
            near = np.zeros(len(i), bool)
            width = np.minimum(cells[i], cells[j])
            for c in np.unique(width):
                at = np.flatnonzero(width == c)
                used, where = np.unique(np.r_[i[at], j[at]], return_inverse=True)
                folded = np.array([_folded(sketch[x], int(c)) for x in used], np.int16)
                for part in range(0, len(at), max(1, 8_000_000 // int(c))):
                    piece = slice(part, part + max(1, 8_000_000 // int(c)))
                    gap = np.abs(folded[where[: len(at)][piece]] - folded[where[len(at) :][piece]]).sum(axis=1, dtype=np.int64)
                    near[at[piece]] = gap <= spare[at[piece]]
            # A pair that an earlier task of this bucket has is left to that task.
            i, j = i[near], j[near]
            known = len(seen)
            seen, first = np.unique(np.r_[seen, np.c_[node[i], node[j]]], axis=0, return_index=True)
            first = first[first >= known] - known
            kept[i[first]] = kept[j[first]] = True
        return frame.loc[kept, ["task", "node", "root"]]

    return dealt.groupBy("bucket").applyInPandas(compare, "task long, node long, root long")


def _leaf_links(suspects: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links that join the components of the members of each task, at most one for each merger.

    The members of a task are compared on their whole sets, but for those in one component already; a run
    of tasks in a partition shares what it has merged.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        def links(node: list[int], root: list[int], items: list[np.ndarray]) -> list[tuple[int, int]]:
            found = []
            n = np.array([len(x) for x in items])
            starts = np.cumsum(n) - n
            values, flat = np.unique(np.concatenate(items), return_inverse=True)
            own = np.zeros(len(values), bool)
            for i in range(len(node) - 1):
                mine = top(root[i])
                if all(top(r) == mine for r in root[i + 1 :]):
                    continue
                place = flat[starts[i] : starts[i] + n[i]]
                own[place] = True
                common = np.add.reduceat(own[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
                own[place] = False
                for j in np.flatnonzero(den * common >= num * (n[i] + n[i + 1 :] - common)).tolist():
                    mine, other = top(root[i]), top(root[i + 1 + j])
                    if mine != other:
                        above[max(mine, other)] = min(mine, other)
                        found.append((node[i], node[i + 1 + j]))
            return found

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        current, held = None, ([], [], [])
        for batch in batches:
            tasks, nodes, roots = (batch.column(c).to_pylist() for c in range(3))
            offsets = batch.column(3).offsets.to_numpy()
            values = batch.column(3).values.to_numpy()
            for k, task in enumerate(tasks):
                if task != current:
                    if len(held[0]) > 1:
                        yield batch_of(links(*held))
                    current, held = task, ([], [], [])
                    if len(above) > STEP:
                        above.clear()
                held[0].append(nodes[k])
                held[1].append(roots[k])
                held[2].append(values[offsets[k] : offsets[k + 1]].copy())
        if len(held[0]) > 1:
            yield batch_of(links(*held))
        released()

    full = suspects.join(sets, "node").select("task", "node", "root", "items")
    return full.repartition("task").sortWithinPartitions("task", "node").mapInArrow(merge, "a long, b long")


def linked_nodes(docs: DataFrame, single: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``node, root`` of the nodes linked with another one, from a written table with one row of :func:`described` a node.

    The table is deleted on the way, as are others once what is made of them is written.
    """
    cells = single.select(F.explode("prefix").alias("region"), "node")
    shared = cells.groupBy("region").agg(F.min("node").alias("pivot"), F.max("node").alias("_far")).where("pivot < _far").drop("_far")
    shared = materialize(shared, "cells")
    # Cells grow with the shingles of the corpus, so this join is a shuffle at every size.
    state = materialize(cells.join(shared, "region").select("region", "node", "pivot"), "members")
    discard(shared)
    cut = state
    state = state.withColumn("mask", F.lit(0))
    members = materialize(single.join(state.select("node").distinct(), "node", "left_semi").select("node", "n", "sketch"), "sketches")
    discard(single)
    radius = (den - num) / den + 1e-9
    is_link = F.col("common") * den >= F.col("joint") * num

    def verified(pairs: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        sets = materialize(whole_sets(docs, width, ends), "sets")
        measured = materialize(_measured(pairs, sets), "measured")
        discard(ends, sets)
        return measured

    links, leaves, roots = None, None, None
    for level in range(DEPTH):
        pairs = state.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        bounds = materialize(_bounded(pairs, members, num, den), "bounds")
        measured = verified(bounds.where("maybe").select("a", "b"))
        found = materialize(measured.where(is_link).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        roots = _heads(links)
        exact = measured.select("a", "b", is_link.alias("ball"), (1 - F.col("common") / F.col("joint")).alias("exact"))
        judged = bounds.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("ball", F.lit(False)).alias("ball"), F.coalesce("exact", "low").alias("far"))
        judged = materialize(judged, "judged")
        discard(bounds, measured)
        placed = state.join(judged, (state["node"] == judged["a"]) & (state["pivot"] == judged["b"]), "left")
        ball = F.coalesce("ball", F.lit(True))  # only the pivot has no row of its own
        # (which region, whether as a guest): outside the ball at home in "rest"; the ball is a guest of "edge".
        rest, edge = F.struct(F.lit(0).alias("part"), F.lit(0).alias("guest")), F.struct(F.lit(1).alias("part"), F.lit(0).alias("guest"))
        inside = F.array(F.struct(F.lit(1).alias("part"), F.lit(1).alias("guest")))
        parts = F.when(ball, inside).when(F.col("far") <= 2 * radius, F.array(rest, edge)).otherwise(F.array(rest))
        placed = placed.withColumn("to", F.explode(parts))
        placed = placed.select(F.xxhash64("region", "to.part").alias("region"), "node", (F.col("mask") * 2 + F.col("to.guest")).alias("mask"))
        left = materialize(_apart(placed, roots), "left")
        discard(judged, cut)
        sizes = left.groupBy("region").agg(F.count("*").alias("size"), F.min(F.when(F.col("mask") % 2 == 0, F.col("node"))).alias("pivot"))
        large = materialize(sizes.where(F.col("size") > LEAF), "large")
        if level == DEPTH - 1 or not large.count():
            leaves = left if leaves is None else leaves.unionByName(left)
            break
        done = left.join(large.select("region"), "region", "left_anti")
        leaves = done if leaves is None else leaves.unionByName(done)
        state = left.join(large, "region").select("region", "node", "pivot", "mask")
    roots = materialize(components(links).toDF("node", "root"), "roots")
    suspects = materialize(_suspects(_apart(leaves, roots), members, num, den), "suspects")
    sets = materialize(whole_sets(docs, width, suspects.select("node")), "sets")
    discard(members)
    found = materialize(_leaf_links(suspects, sets, num, den), "links")
    discard(suspects, sets)
    return materialize(components(links.unionByName(found)).toDF("node", "root"), "roots")


def jaccard_join(
    docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Rows link when ``den * common >= num * joint`` for the distinct runs of ``width`` words; shorter texts
    are one run. A component is named by its smallest id. Texts without words and null texts have no
    shingles, link with nothing and keep their own id. Repeated rows and texts with equal sets link; null
    ids are named by the smallest id of their component, null if it has none. An empty table gives no rows.
    Shingles and sets are compared by 64-bit hashes.
    """
    docs = id_and_text(docs, id_col, text_col)
    whole = materialize(described(docs, width, frequent_shingles(docs, width), num, den), "described")
    rows = materialize(whole.select("doc_id", "node", "n"), "rows")
    single = whole.where("node is not null").select("node", "prefix", "n", "sketch").dropDuplicates(["node"])
    single = materialize(single, "nodes")
    discard(whole)
    found = linked_nodes(docs, single, width, num, den)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "root").select("node", "component_id")
    placed = rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"))
