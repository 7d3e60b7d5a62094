"""Nearest rows and components within blocks of equal columns, in one shuffle of the rows.

Rows are placed by their block and sorted by it, so that a task meets a block as one run of rows. Its
pairs are scored, ranked and returned there with the columns of both rows: what is shuffled grows with the
rows and not with their pairs, which neither meet again in a window nor join their rows afterwards.
Blocks of more than ``BLOCK_ROWS`` rows are cut into slices by ``nearest_join``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.operators.clusters import components
from factloom.operators.nearest import DISTANCE_DIGITS, _matrix, nearest_join
from factloom.session import materialize

#: Rows of a block that one task compares, and rows of a partition.
BLOCK_ROWS, PARTITION_ROWS = 16_384, 100_000
#: Blocks up to this size are scored as they are, larger ones without needless copies of a vector.
FOLD_ROWS = 256


def _runs(codes):
    """Bounds of the runs of equal numbers."""
    import numpy as np

    cuts = np.nonzero(np.diff(codes))[0] + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)])


def _first_of(groups, n: int):
    """Whether a row is among the first ``n`` of its group, in row order."""
    import numpy as np

    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    kept = np.empty(len(groups), bool)
    kept[order] = np.arange(len(groups)) - np.searchsorted(ordered, ordered, side="left") < n
    return kept


def _useful(vectors, owners, k: int):
    """Rows that any query could return: of equal vectors the first k of an owner, and 2k in all."""
    import numpy as np

    _, same = np.unique(vectors, axis=0, return_inverse=True)
    same = same.ravel()
    _, owned = np.unique(np.stack([same, owners]), axis=1, return_inverse=True)
    mine = np.nonzero(_first_of(owned.ravel(), k))[0]
    return mine[_first_of(same[mine], 2 * k)]


def _nearest_of_block(vectors, owners, times, k: int):
    """(query row, base row, distance, rank); rows are in the order that breaks ties."""
    import numpy as np

    n = len(vectors)
    base = np.arange(n) if n <= FOLD_ROWS else _useful(vectors, owners, k)
    found = []
    for low in range(0, n, 512):
        high = min(n, low + 512)
        distance = np.round(1.0 - vectors[low:high] @ vectors[base].T, DISTANCE_DIGITS) + 0.0
        barred = (owners[low:high, None] == owners[None, base]) | (times[None, base] >= times[low:high, None])
        distance[barred] = np.inf
        wanted = ~barred
        if len(base) > k:
            wanted &= distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero(wanted)
        value = distance[row, column]
        order = np.lexsort((column, value, row))
        row, column, value = row[order], column[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < k
        found.append((row[keep] + low, base[column[keep]], value[keep], rank[keep] + 1))
    return [np.concatenate(x) for x in zip(*found)]


def _packed(ids: Column) -> Column:
    """Ids of a word and 32 hex digits, such as those of facts, as bytes at half the length; others as they are.

    The word is kept behind the digits, and a last byte tells both forms apart.
    """
    digits = F.unhex(F.right(ids, F.lit(32)))
    word = F.encode(F.left(ids, F.length(ids) - 32), "utf-8")
    short = F.concat(digits, word, F.lit(bytearray(b"\1")))
    return F.when(ids.rlike("^[a-z]*_[0-9a-f]{32}$"), short).otherwise(F.concat(F.encode(ids, "utf-8"), F.lit(bytearray(b"\0"))))


def _unpacked(ids: Column) -> Column:
    """The ids that ``_packed`` was given."""
    n = F.length(ids)
    whole = F.decode(F.substring(ids, F.lit(1), n - 1), "utf-8")
    word = F.decode(F.substring(ids, F.lit(17), n - 17), "utf-8")
    digits = F.lower(F.hex(F.substring(ids, F.lit(1), F.lit(16))))
    return F.when(F.substring(ids, n, F.lit(1)) == F.lit(bytearray(b"\1")), F.concat(word, digits)).otherwise(whole)


def _search(k: int, columns: list[str], arrow_schema):
    def matches(table) -> Iterator:
        """Pairs of whole blocks."""
        import numpy as np
        import pyarrow as pa

        table = table.filter(table.column("vec").is_valid())
        if not table.num_rows:
            return
        vectors = _matrix(table)
        owners = table.column("differ").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        times = table.column("earlier").to_numpy()
        blocks = table.column("block").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        picked, size = [], 0

        def out():
            q, b, d, r = (np.concatenate(x) for x in zip(*picked))
            a_rows, b_rows = table.take(pa.array(q)), table.take(pa.array(b))
            sides = [pa.StructArray.from_arrays([s.column(c).combine_chunks() for c in columns], columns) for s in (a_rows, b_rows)]
            ids = [s.column("id").combine_chunks() for s in (a_rows, b_rows)]
            arrays = [a_rows.column("block").combine_chunks(), *ids, pa.array(d), pa.array(r.astype(np.int32)), *sides]
            return pa.table(arrays, names=arrow_schema.names).cast(arrow_schema).to_batches()

        for low, high in _runs(blocks):
            if high - low < 2:
                continue
            q, b, d, r = _nearest_of_block(vectors[low:high], owners[low:high], times[low:high], k)
            if len(q):
                picked.append((q + low, b + low, d, r))
                size += len(q)
            if size > 1 << 15:
                yield from out()
                picked, size = [], 0
        if size:
            yield from out()

    def search(batches) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            codes = table.column("block").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start = list(_runs(codes))[-1][0]
            held = table.slice(start)
            if start:
                yield from matches(table.slice(0, start))
        if held is not None:
            yield from matches(held)

    return search


def nearest_in_blocks(
    rows: DataFrame,
    k: int,
    *,
    match: list[str],
    differ: str,
    earlier: str,
    embed: Callable[[DataFrame], DataFrame],
    columns: list[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``block, query_id, base_id, distance, rank, a, b``: as ``nearest_join`` of ``rows`` with themselves.

    ``block`` names the run that a pair lies in; it is null for pairs of large blocks, which come in no order.
    ``a`` and ``b`` are structs of ``columns`` of both rows. ``embed`` adds the column ``embedding``; it is
    applied to the placed rows, so vectors are not shuffled. Ids must be unique.
    """
    text_ids = isinstance(rows.schema["id"].dataType, T.StringType)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in match]
    block = F.concat_ws("\1", *parts)
    rows = rows.withColumn("_block", block)
    count = rows.count()
    large = rows.groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("_block")
    large = materialize(large, "large-blocks")
    any_large = not large.isEmpty()
    usual = rows.join(large, "_block", "left_anti") if any_large else rows
    usual = usual.withColumn("id", _packed(F.col("id"))) if text_ids else usual
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + count // PARTITION_ROWS)
    # The block follows from its columns and is made of them anew where the rows arrive.
    placed = usual.drop("_block").repartition(tasks, block).withColumn("_block", block)
    placed = placed.withColumn("id", _unpacked(F.col("id"))) if text_ids else placed
    placed = placed.sortWithinPartitions("_block", earlier, "id")
    kept = list(dict.fromkeys(c for c in columns if c != "id"))
    ready = embed(placed).select(
        "id",
        F.col("_block").alias("block"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col(differ).cast("string").alias("differ"),
        F.col(earlier).cast("long").alias("earlier"),
        *[c for c in kept if c not in ("differ", "earlier")],
    )
    side = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in columns])
    schema = T.StructType(
        [
            T.StructField("block", T.StringType(), False),
            T.StructField("query_id", rows.schema["id"].dataType),
            T.StructField("base_id", rows.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField("a", side),
            T.StructField("b", side),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    found = ready.mapInArrow(_search(k, columns, to_arrow_schema(schema)), schema)
    if not any_large:
        return found
    big = materialize(rows.join(large, "_block", "left_semi"), "large-rows")
    vectors = embed(big).select("id", F.col(differ).alias("differ"), F.col(earlier).alias("earlier"), "embedding", "_block")
    pairs = nearest_join(vectors, vectors, k, match=["_block"], differ="differ", earlier="earlier")
    for name, one in (("query_id", "a"), ("base_id", "b")):
        wide = big.select(F.col("id").alias(name), F.struct(*columns).alias(one))
        pairs = pairs.join(wide, name)
    pairs = pairs.withColumn("block", F.lit(None).cast("string"))
    return found.unionByName(pairs.select(*found.columns))


def _joined_runs(batches) -> Iterator:
    """Vertex and smallest member of the components of each run of pairs with one block."""
    import pyarrow as pa

    block, parent = None, {}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def batch_of(rows: list) -> pa.RecordBatch:
        sides = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(sides, kinds)], names=["vertex", "root", "settled"])

    for batch in batches:
        done: list = []
        for name, u, v in zip(*(column.to_pylist() for column in batch.columns)):
            if name is None:
                done.append((u, v, False))
                continue
            if name != block:
                done += [(x, root(x), True) for x in parent]
                block, parent = name, {}
            u, v = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            if u != v:
                parent[max(u, v)] = min(u, v)
        yield batch_of(done)
    yield batch_of([(x, root(x), True) for x in parent])


def components_in_blocks(pairs: DataFrame) -> DataFrame:
    """(vertex, root) of pairs ``block, u, v`` that never cross blocks; see :func:`components`.

    Pairs must come as ``nearest_in_blocks`` returns them, a block as one run in one partition. Each run is
    settled where it lies; pairs without a block go to :func:`components`.
    """
    found = pairs.select("block", "u", "v").mapInArrow(_joined_runs, "vertex string, root string, settled boolean")
    found = materialize(found, "block-components")
    settled = found.where("settled").select("vertex", "root")
    left = found.where("not settled").select("vertex", "root")
    return settled if left.isEmpty() else settled.unionByName(components(left))
