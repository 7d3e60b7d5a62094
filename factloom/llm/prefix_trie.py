"""Prefix trie of conversations with subtree totals by depth bands.

A node is a distinct sequence of first turns. Its identity is the exclusive-or of 128-bit hashes of
(place, turn) over the sequence, a running value that blocks of a long conversation can compute apart.
Totals go up in bands of a fixed height: each node explodes to its ancestors inside its band only, and
bands are joined by their roots, whose own tree is a trie of one depth in ``BAND``, rolled up the same way.
So rounds grow with the logarithm of the depth and no row explodes to more than ``BAND`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.session import materialize

#: Height of a band, and depths that one block of a conversation covers (a multiple of the height).
BAND, BLOCK = 16, 512
#: Bytes of one piece of a list of members, at most.
PIECE = 4096

_ID = ("a", "b")
_ROOT = ("cast(0 as long) a", "cast(0 as long) b")


def _two(*columns: Column | str) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same columns from different seeds."""
    return F.xxhash64(F.lit("first"), *columns), F.xxhash64(F.lit("second"), *columns)


def ordered_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, pos, n_turns, t1, t2, chars``: turns numbered from 0 in their conversation, texts as hashes.

    The whole table is sorted by ranges, so that a conversation of any length is cut over many tasks;
    numbers inside a task are joined with the counts of the tasks before it.
    """
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    order = ("conv_id", "turn", "role", "text")
    t1, t2 = _two("role", "text")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", t1.alias("t1"), t2.alias("t2"), F.char_length("text").alias("chars"))
    dealt = dealt.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    dealt = materialize(dealt, "turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    of_one = Window.partitionBy("conv_id")
    before = F.sum("n").over(of_one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        "conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(of_one).alias("n_turns")
    )
    return dealt.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("line") + F.col("shift")).alias("pos"), "n_turns", "t1", "t2", "chars")


def branched(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation: the first ``head`` turns of conversation ``base``, then its own after ``head``.

    ``head`` is at most ``most``. Returns the turns (``conv_id, depth, t1, t2, chars``, depths from 1) and the
    conversations (``conv_id, length``), which may have no turn left.
    """
    convs = turns.where("pos = 0").select("conv_id", "n_turns", base.alias("base"), head.cast("long").alias("head"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.least("n_turns", F.lit(most)).alias("there"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    length = F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("n_turns") - F.col("head"))
    convs = materialize(convs.select("conv_id", "base", "head", "taken", length.alias("length")), "conversations")
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where("pos >= head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("depth"), "t1", "t2", "chars")
    lead = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lead = lead.join(convs.select("conv_id", "base", "taken"), "base").where("pos < taken")
    lead = lead.select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "chars")
    return own.unionByName(lead), convs.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, chars``, the node ``(a, b)`` of each first turns and its parent ``(pa, pb)``."""
    h1, h2 = _two("depth", "t1", "t2")
    rows = turns.select("conv_id", "depth", "chars", h1.alias("h1"), h2.alias("h2"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.bit_xor("h1").over(so_far)).withColumn("b", F.bit_xor("h2").over(so_far))
    # Only conversations of more than one block have anything before a block.
    ends = rows.where(F.col("depth") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), "a", "b")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("conv_id", "block", F.bit_xor("a").over(earlier).alias("oa"), F.bit_xor("b").over(earlier).alias("ob"))
    rows = rows.join(ends, ["conv_id", "block"], "left")
    for name in _ID:
        rows = rows.withColumn(name, F.col(name).bitwiseXOR(F.coalesce(f"o{name}", F.lit(0))))
    return rows.select(
        "conv_id", "depth", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("h1")).alias("pa"), F.col("b").bitwiseXOR(F.col("h2")).alias("pb")
    )


def _banded(rows: DataFrame) -> DataFrame:
    """Add ``up``, the nodes of the band from its first to this one, and ``(ta, tb)``, the root of the band.

    ``rows`` have ``conv_id, depth, a, b, pa, pb``; a band holds the depths after one multiple of ``BAND``
    up to the next, which is the root of the band below.
    """
    band = Window.partitionBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK), F.floor((F.col("depth") - 1) / BAND)).orderBy("depth")
    band = band.rowsBetween(Window.unboundedPreceding, 0)
    up = F.collect_list(F.struct("a", "b")).over(band)
    return rows.withColumn("up", up).withColumn("ta", F.first("pa").over(band)).withColumn("tb", F.first("pb").over(band))


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each node of banded ``rows``: all rows of a node agree but for their conversation."""
    same = [F.any_value(c).alias(c) for c in ("depth", "up", "ta", "tb")]
    return rows.groupBy(*_ID).agg(*same)


def _rollup(rows: DataFrame, values: DataFrame, names: list[str], deepest: int) -> DataFrame:
    """``a, b`` and the totals of ``names`` over each node's subtree.

    ``rows`` are prefix rows as :func:`_banded` takes them, ``values`` has every node, the root included.
    """
    if deepest == 0:
        return values
    banded = _banded(rows)
    nodes = materialize(_nodes(banded).join(values, list(_ID)), "band")
    inner = F.col("depth") % BAND != 0
    # The tree of band roots: a root carries its own value and those inside the band below it.
    from_inside = nodes.where(inner).select(F.col("ta").alias("a"), F.col("tb").alias("b"), *names)
    roots = nodes.where(~inner).select(*_ID, *names).unionByName(values.where("a = 0 and b = 0"))
    carried = roots.unionByName(from_inside).groupBy(*_ID).agg(*[F.sum(n).alias(n) for n in names])
    above = banded.where(~inner).select(
        "conv_id", (F.col("depth") / BAND).cast("long").alias("depth"), *_ID, F.col("ta").alias("pa"), F.col("tb").alias("pb")
    )
    totals = materialize(_rollup(above, carried, names, deepest // BAND), "band_roots")
    # Inside a band: nodes send their value to themselves and up, band roots below send completed totals up.
    done = nodes.where(~inner).select(*_ID, F.slice("up", 1, BAND - 1).alias("up")).join(totals, list(_ID))
    sent = nodes.where(inner).select("up", *names).unionByName(done.select("up", *names))
    inside = sent.select(F.explode("up").alias("u"), *names).groupBy("u.a", "u.b").agg(*[F.sum(n).alias(n) for n in names])
    return inside.unionByName(totals)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: hash of the ascending decimal ids of each node, comma-joined.

    A range sort cuts a hot node over many tasks, which join ids to pieces; a second pass streams the few
    pieces of a node in order through one hash, so no list of members is ever held.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"key": None, "first": 0, "ids": [], "size": 0}
        for batch in batches:
            out: list[tuple] = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != held["key"] or held["size"] >= PIECE:
                    if held["ids"]:
                        out.append((*held["key"], held["first"], ",".join(held["ids"])))
                    held = {"key": (a, b), "first": conv, "ids": [], "size": 0}
                held["ids"].append(str(conv))
                held["size"] += len(held["ids"][-1]) + 1
            yield _batch(out, pieces)
        if held["ids"]:
            yield _batch([(*held["key"], held["first"], ",".join(held["ids"]))], pieces)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield _batch(out, hashes)
        if key is not None:
            yield _batch([(*key, sha.hexdigest())], hashes)

    long = pa.int64()
    pieces = pa.schema([("a", long), ("b", long), ("first", long), ("ids", pa.string())])
    hashes = pa.schema([("a", long), ("b", long), ("ends_sha256", pa.string())])
    dealt = ends.select(*_ID, "conv_id").repartitionByRange(*_ID, "conv_id").sortWithinPartitions(*_ID, "conv_id")
    joined = dealt.mapInArrow(join, "a long, b long, first long, ids string")
    return joined.repartition(*_ID).sortWithinPartitions(*_ID, "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (``conv_id, depth, t1, t2, chars``) of ``convs``.

    ``convs`` are all conversations (``conv_id, length``), those without turns included: they end in the
    root. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. No conversations give no
    rows. A first turn that a third of all conversations share is summed in every task before it is shuffled.
    """
    rows = materialize(_prefixes(turns), "prefixes")
    facts = rows.groupBy(*_ID).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.max(c).alias(c) for c in ("depth", "chars", "pa", "pb")],
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.selectExpr(*_ROOT, "conv_id", "n_convs", "cast(0 as long) depth", "0 chars", "cast(null as long) pa", "cast(null as long) pb")
    nodes = materialize(facts.unionByName(top), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, list(_ID), "left").fillna(0, ["n_children"]), "with_children")
    values = nodes.select(
        *_ID, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).cast("long").alias("saved_tokens")
    )
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
    names = ["n_leaves", "saved_tokens"]
    totals = _rollup(rows.select("conv_id", "depth", *_ID, "pa", "pb"), values, names, deepest)
    ends = rows.join(convs, "conv_id").where(F.col("depth") == F.col("length")).select(*_ID, "conv_id")
    ends = ends.unionByName(convs.where("length = 0").selectExpr(*_ROOT, "conv_id"))
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["pa", "pb"], "left").join(totals, list(_ID)).join(_end_hashes(ends), list(_ID), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *names, F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )


def conversation_trie(
    conversations: DataFrame,
    base: Column | None = None,
    head: Column | None = None,
    most: int = 0,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """:func:`prefix_trie` of a table of turns, of which conversations may first be rebuilt (:func:`branched`).

    ``base`` and ``head`` are columns of ``conv_id``; without them conversations stay as they are. Turns are
    ordered by turn (null first), then role and text by code point, so repeated turns stay, in a fixed
    order. Null roles and texts count as empty; rows without a conversation id take no part; other columns
    are not read. Texts of any length become hashes in the first pass. An empty table gives no rows.
    """
    turns = ordered_turns(conversations, id_col, turn_col, role_col, text_col)
    if base is None or head is None:
        base, head, most = F.col("conv_id"), F.lit(0), 0
    return prefix_trie(*branched(materialize(turns, "numbered"), base, head, most))
