"""Exact and approximate top-k cosine join of two vector tables.

The scoring work is cut into tasks of bounded size. Base rows get a *cell*; the queries that can
have neighbours in a cell are sent there, and both sides of a cell are split into slices, so a cell
that holds a third of all rows is just many tasks. A task multiplies two small matrices and keeps
the k best per query; pairs never leave it. The partial results meet in a rank window.

* with ``match`` columns the cell is a hash of them: one pass; only blocks of more than
  ``HOT_BLOCK`` rows, whose pairs would be too many to score, go the other way;
* without, cells are the leaves of a tree of pivot regions (``pivot_tree``). Pass one searches the
  query's own leaf and gives an upper bound of its k-th distance; pass two visits only those leaves
  that the triangle inequality does not rule out (a pivot-based kNN join as in Lu et al., 2012), so
  the result is exact; ``probes`` searches the nearest of a flat set of regions only.

Copies of a vector are folded first: of equal vectors only those that can be in a result are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.vectors import unit_vector
from factloom.operators.pivot_tree import PivotTree
from factloom.session import discard, materialize

ROWS_PER_TASK = 4096
# Slices grow with a table until there are about so many tasks a pass, and up to so many numbers a slice, so
# that the copies of a row that are shuffled stay as many as they are.
TASKS, SLICE_VALUES = 256, 1 << 22
# Copies of rows that a search shuffles at a time, by estimate: with more, shares of the queries follow one another.
SHARE_COPIES = 2_000_000
# Distances that a task holds at a time.
BLOCK_SCORES = 1 << 21
# Leaves of a large table: a row is sent to each leaf that it visits.
MAX_LEAVES = 32
# Regions of the approximate search.
MAX_CELLS = 1024
MAX_BROADCAST_CELLS = 100_000
HOT_BLOCK = 64 * ROWS_PER_TASK
# Up to so many pairs, scoring all of them in slices costs less than placing rows in regions.
SCORE_ALL = 1 << 33
DISTANCE_DIGITS = 9


def _prepare(rows: DataFrame, key: str, vector: str, match: list[str], differ, earlier) -> DataFrame:
    """id, vector and the filter columns under fixed names."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in match]
    # Single precision is scored as double precision, but not stored and shuffled as such.
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return rows.where(F.col(vector).isNotNull()).select(
        F.col(key).alias("id"),
        F.col(vector).cast(kind).alias("vec"),
        F.concat_ws("\1", *parts).alias("match") if parts else F.lit("").alias("match"),
        (F.col(differ).cast("string") if differ else F.lit("")).alias("differ"),
        (F.col(earlier).cast("long") if earlier else F.lit(0).cast("long")).alias("earlier"),
    )


def _fold_copies(base: DataFrame, k: int, differ) -> DataFrame:
    """Keep of equal vectors the first ones that any query could return.

    Ties are ranked by (earlier, id), so "earlier" queries accept a prefix of that order. Per
    ``differ`` value k rows are enough, and over all values 2k, as a query excludes one value.
    Only vectors with more than k copies are touched; counting hashes finds them (a collision
    merely makes a group look larger).
    """
    digest = F.xxhash64("match", "vec").alias("digest")
    counts = base.select(digest).groupBy("digest").agg(F.count("*").alias("n"))
    crowded = counts.where(F.col("n") > k).select("digest")
    if crowded.isEmpty():
        return base
    hashed = base.select("*", digest)
    order = ["earlier", "id"]

    def first(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_copy", rank).where(F.col("_copy") <= n).drop("_copy")

    copies = hashed.join(crowded, "digest", "left_semi")
    if differ:
        copies = first(copies, ["match", "vec", "differ"], k)
    copies = first(copies, ["match", "vec"], 2 * k if differ else k)
    single = hashed.join(crowded, "digest", "left_anti")
    return materialize(single.unionByName(copies).drop("digest"), "base")


def _matrix(table):
    """Vectors as rows of length one; a zero vector stays zero, at distance 1 from all."""
    import numpy as np

    column = table.column("vec").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1).astype(np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _result_schema(queries: DataFrame, base: DataFrame):
    from pyspark.sql import types as T

    return T.StructType(
        [
            T.StructField("query_id", queries.schema["id"].dataType),
            T.StructField("base_id", base.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("earlier", T.LongType()),
        ]
    )


def _scorer(k: int, match: bool, differ: bool, earlier: bool, arrow_schema):
    """Group function: the k best eligible base rows for every query of one task."""

    def blocks(queries, base, codes):
        """Row numbers of both sides for each match value present on both, base order kept."""
        import numpy as np

        if not match:
            yield np.arange(queries.num_rows), np.arange(base.num_rows)
            return
        sides = []
        for values in codes("match"):
            order = np.argsort(values, kind="stable")
            keys, starts = np.unique(values[order], return_index=True)
            sides.append(dict(zip(keys.tolist(), np.split(order, starts[1:]))))
        for key, rows in sides[0].items():
            if key in sides[1]:
                yield rows, sides[1][key]

    def score(queries, base):
        import numpy as np
        import pyarrow as pa

        if queries.num_rows == 0 or base.num_rows == 0:
            return arrow_schema.empty_table()
        base = base.sort_by([("earlier", "ascending"), ("id", "ascending")])
        left, right = _matrix(queries), _matrix(base)

        def codes(name):
            both = pa.concat_arrays(
                [t.column(name).combine_chunks() for t in (queries, base)]
            ).dictionary_encode()
            index = both.indices.to_numpy(zero_copy_only=False)
            return index[: queries.num_rows], index[queries.num_rows :]

        differ_codes = codes("differ") if differ else None
        times = [t.column("earlier").to_numpy() for t in (queries, base)] if earlier else None
        picked_q, picked_b, picked_d = [], [], []
        for q_rows, b_rows in blocks(queries, base, codes):
            b_vectors = right[b_rows].T
            at_once = max(1, BLOCK_SCORES // len(b_rows))
            for low in range(0, len(q_rows), at_once):
                rows = q_rows[low : low + at_once]
                distance = np.round(1.0 - left[rows] @ b_vectors, DISTANCE_DIGITS) + 0.0
                if differ:
                    distance[differ_codes[0][rows, None] == differ_codes[1][None, b_rows]] = np.inf
                if earlier:
                    distance[times[1][None, b_rows] >= times[0][rows, None]] = np.inf
                wanted = np.isfinite(distance)
                if distance.shape[1] > k:
                    wanted &= distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
                row, column = np.nonzero(wanted)
                value = distance[row, column]
                order = np.lexsort((column, value, row))
                row, column, value = row[order], column[order], value[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
                picked_q.append(rows[row[keep]])
                picked_b.append(b_rows[column[keep]])
                picked_d.append(value[keep])
        if not picked_q:
            return arrow_schema.empty_table()
        q, b, d = (np.concatenate(x) for x in (picked_q, picked_b, picked_d))
        return pa.table(
            [
                queries.column("id").take(pa.array(q)),
                base.column("id").take(pa.array(b)),
                pa.array(d),
                base.column("earlier").take(pa.array(b)),
            ],
            schema=arrow_schema,
        )

    return score


def _score_cells(
    queries: DataFrame, base: DataFrame, k: int, rows_per_task: int, flags, cells: int
) -> DataFrame:
    """Both sides carry ``cell``; slices of at least about ``rows_per_task`` rows meet in one task.

    Of a row as many copies are shuffled as the other side has slices. So slices grow with the pairs of a cell,
    once those make more than ``TASKS`` tasks in all, until their vectors have ``SLICE_VALUES`` numbers.
    The slice plan has at most ``cells`` rows of three numbers, so its size is known here.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _result_schema(queries, base)

    def sizes(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.count("*").alias(side), F.max(F.size("vec")).alias(side + "_dim"))

    both = sizes(queries, "q").join(sizes(base, "b"), "cell")
    even = F.sqrt(F.col("q").cast("double") * F.col("b") * max(1, cells) / TASKS)
    most = F.lit(SLICE_VALUES) / F.greatest("q_dim", "b_dim", F.lit(1))
    rows_of = F.greatest(F.least(even, most), F.lit(float(rows_per_task)))
    plan = both.select("cell", *[F.ceil(F.col(side) / rows_of).alias(side + "_slices") for side in ("q", "b")])
    if cells <= MAX_BROADCAST_CELLS:
        plan = F.broadcast(plan)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    def sliced(rows: DataFrame, mine: str, other: str) -> DataFrame:
        kept = ["cell", "id", "vec", "match", "differ", "earlier"]
        placed = rows.join(plan, "cell").withColumn(mine[0] + "_slice", own(mine))
        return placed.select(*kept, mine[0] + "_slice", every(other).alias(other[0] + "_slice"))

    keys = ["cell", "q_slice", "b_slice"]
    left = sliced(queries, "q_slices", "b_slices").groupBy(*keys)
    right = sliced(base, "b_slices", "q_slices").groupBy(*keys)
    scorer = _scorer(k, *flags, to_arrow_schema(schema))
    return left.cogroup(right).applyInArrow(scorer, schema)


def _best(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "earlier", "base_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_shares(q: DataFrame, b_rows: int, visited: int, cells: int, rows_per_task: int, search) -> DataFrame:
    """``search`` of shares of the queries one after another, so that the copies of one share leave the disk before the next.

    A query is sent to about ``visited`` of the ``cells`` that hold ``b_rows``.
    """
    q_rows = q.count() * visited
    slice_rows = max(rows_per_task, math.sqrt(q_rows * b_rows / max(1, cells) / TASKS), 1)
    copies = q_rows * max(1, b_rows / cells / slice_rows) + b_rows * max(1, q_rows / cells / slice_rows) if cells else 0
    shares, found = max(1, math.ceil(copies / SHARE_COPIES)), None
    if shares == 1:
        return search(q)
    for n in range(shares):
        own = F.pmod(F.xxhash64("id", F.lit("share")), F.lit(shares)) == n
        part = materialize(search(q.where(own)), "share")
        found = part if found is None else found.unionByName(part)
    return found


def _near_pivots(rows: DataFrame, pivots, take: int) -> DataFrame:
    """Add the ``take`` nearest pivots as ``cells`` and the distance to the nearest."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    schema = T.StructType(
        [*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("reach", T.DoubleType())]
    )
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            gap = _gaps(_matrix(table), pivots)
            order = np.argsort(gap, axis=1, kind="stable")[:, :take]
            cells = pa.array(list(order.astype(np.int32)), type=pa.list_(pa.int32()))
            out = table.append_column("cells", cells).append_column("reach", pa.array(gap.min(axis=1)))
            yield from out.cast(arrow_schema).to_batches()

    return rows.mapInArrow(run, schema)


def _gaps(vectors, pivots):
    """Euclidean distances of unit vectors to the pivots."""
    import numpy as np

    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ pivots.T), 0.0))


def nearest_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    query_id: str = "id",
    base_id: str = "id",
    vector: str = "embedding",
    match: list[str] | None = None,
    differ: str | None = None,
    earlier: str | None = None,
    probes: int | None = None,
    cells: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    hot_block: int = HOT_BLOCK,
) -> DataFrame:
    """The ``k`` nearest base rows of every query: ``query_id, base_id, distance, rank``.

    ``match`` columns must be equal, the ``differ`` column must differ, and the ``earlier`` column
    (long) must be smaller on the base side; all filters apply before ranking. The distance is
    1 - cos, rounded to nine digits so that ties fall to (earlier, id) on every platform. ``k`` is
    the only limit on the result; with fewer eligible rows all of them are returned.
    """
    match = match or []
    flags = (bool(match), bool(differ), bool(earlier))
    q = materialize(_prepare(queries, query_id, vector, match, differ, earlier), "queries")
    if queries is base and query_id == base_id:
        b = q.select(*[F.col(c).alias(c) for c in q.columns])
    else:
        b = _prepare(base, base_id, vector, match, differ, earlier)
        if match:
            b = b.join(q.select("match").distinct(), "match", "left_semi").select(*b.columns)
        b = materialize(b, "base")
    b = _fold_copies(b, k, differ)
    regions = lambda q, b: _by_regions(q, b, k, flags, cells, probes, rows_per_task)
    if not match:
        return regions(q, b)
    hot = b.groupBy("match").agg(F.count("*").alias("n")).where(F.col("n") > hot_block).select("match")
    if hot.isEmpty():
        return _by_buckets(q, b, k, flags, rows_per_task)
    hot = materialize(hot, "hot")
    part = lambda rows, how: materialize(rows.join(hot, "match", how).select(*rows.columns), "part")
    usual = _by_buckets(part(q, "left_anti"), part(b, "left_anti"), k, flags, rows_per_task)
    return usual.unionByName(regions(part(q, "left_semi"), part(b, "left_semi")))


def _by_buckets(q: DataFrame, b: DataFrame, k: int, flags, rows_per_task: int) -> DataFrame:
    """Blocks of equal ``match`` meet in hash buckets; their pairs are all scored."""
    buckets = max(1, math.ceil(b.count() / rows_per_task))
    place: Column = F.pmod(F.xxhash64("match"), F.lit(buckets)).cast("int")
    parts = _score_cells(
        q.withColumn("cell", place), b.withColumn("cell", place), k, rows_per_task, flags, buckets
    )
    return _best(parts, k).drop("earlier")


def _by_regions(q: DataFrame, b: DataFrame, k: int, flags, cells, probes, rows_per_task: int) -> DataFrame:
    """The exact search of a pivot tree, or that of the ``probes`` nearest of some flat regions.

    ``cells`` asks for about so many leaves or regions.
    """
    import numpy as np

    n = b.count()
    if cells is None and (probes is not None or n * q.count() <= SCORE_ALL):
        cells = 1 if probes is None else min(MAX_CELLS, max(1, int(math.sqrt(n))))
    if cells != 1 and probes is None:
        leaf_rows = max(rows_per_task, n // MAX_LEAVES) if cells is None else max(1, n // cells)
        return _by_tree(q, b, k, flags, leaf_rows, rows_per_task)
    sample = []
    if cells > 1:
        directed = b.where(F.exists("vec", lambda x: x != 0))
        sample = directed.orderBy(F.xxhash64("id"), "id").limit(cells).select("vec").collect()
    if not sample:
        b = b.withColumn("cell", F.lit(0))

        def score(q: DataFrame) -> DataFrame:
            return _best(_score_cells(q.withColumn("cell", F.lit(0)), b, k, rows_per_task, flags, 1), k).drop("earlier")

        return _in_shares(q, n, 1, 1, rows_per_task, score)
    pivots = np.array([row.vec for row in sample])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    b = materialize(
        _near_pivots(b, pivots, 1).withColumn("cell", F.col("cells")[0]).drop("cells"), "cells"
    )

    def score(q: DataFrame) -> DataFrame:
        near = _near_pivots(q, pivots, probes)
        return _best(_score_cells(near.withColumn("cell", F.explode("cells")), b, k, rows_per_task, flags, cells), k).drop("earlier")

    return _in_shares(q, n, probes, cells, rows_per_task, score)


def _by_tree(q: DataFrame, b: DataFrame, k: int, flags, leaf_rows: int, rows_per_task: int) -> DataFrame:
    """Leaves of a pivot tree in two pruned passes; exact."""
    tree = PivotTree(b, leaf_rows, rows_per_task)
    leaves = tree.leaves.select("cell").distinct().count()
    q = materialize(tree.homes(q), "placed")
    own = materialize(_best(_score_cells(q, tree.leaves, k, rows_per_task, flags, leaves), k).drop("rank"), "own")
    bounds = own.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    pending = q.join(bounds, q.id == bounds.query_id, "left").drop("query_id").withColumnRenamed("cell", "home")
    pending = pending.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def search(asked: DataFrame) -> DataFrame:
        passed: list[DataFrame] = []
        others = materialize(tree.visits(asked, flags, passed), "visits")
        discard(*passed)
        rest = _score_cells(others, tree.leaves, k, rows_per_task, flags, leaves)
        mine = own.join(asked.select(F.col("id").alias("query_id")), "query_id", "left_semi")
        best = materialize(_best(mine.unionByName(rest), k).drop("earlier"), "best")
        discard(others)
        return best

    # By estimate a query visits all leaves, as it does where vectors spread evenly.
    return _in_shares(pending, tree.leaves.count(), leaves, leaves, rows_per_task, search)


def lsh_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    query_id: str = "id",
    base_id: str = "id",
    vector: str = "embedding",
    tables: int = 6,
    bucket: float = 0.3,
    reach: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Approximate ``nearest_join`` by random projections: ``query_id, base_id, distance, rank``.

    Unit vectors are hashed by ``tables`` random projections, cut into buckets of width ``bucket``; vectors
    that share a bucket of any table and lie within the Euclidean distance ``reach`` are candidates, which
    are ranked by the exact distance of :func:`nearest_join`. Copies of a vector are folded first. Buckets are
    scored in slices as the cells of the exact search are, so pairs never leave a task.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    flags = (None, None)
    q = materialize(_prepare(queries, query_id, vector, [], *flags), "queries")
    b = _fold_copies(materialize(_prepare(base, base_id, vector, [], *flags), "base"), k, None)
    unit = array_to_vector(unit_vector(F.col("vec"))).alias("unit")
    hasher = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    model = hasher.fit(b.select(unit))

    def placed(rows: DataFrame) -> DataFrame:
        """A row for each table, whose cell is the table's number and the bucket."""
        hashed = model.transform(rows.select("*", unit)).select(*rows.columns, F.posexplode("hashes").alias("table", "hash"))
        number = vector_to_array("hash")[0].cast("long")
        return hashed.withColumn("cell", F.concat_ws(":", "table", number)).select("cell", *rows.columns)

    held = materialize(placed(b), "buckets")
    cells = held.select("cell").distinct().count()

    def search(asked: DataFrame) -> DataFrame:
        found = _score_cells(placed(asked), held, k, ROWS_PER_TASK, (False, False, False), cells)
        # The k best of a table hold those of its pairs that are among the k best of all tables.
        near = found.where(F.sqrt(2 * F.col("distance")) < reach).groupBy("query_id", "base_id")
        return _best(near.agg(F.min("distance").alias("distance"), F.lit(0).alias("earlier")), k).drop("earlier")

    return _in_shares(q, held.count(), tables, cells, ROWS_PER_TASK, search)


def filter_metadata(rows: DataFrame, where: dict) -> DataFrame:
    """Metadata filter before ranking: ``{"field": value}`` or ``{"field": {"$ne": value}}``."""
    for field, value in where.items():
        if isinstance(value, dict):
            ((operator, operand),) = value.items()
            if operator == "$eq":
                rows = rows.where(F.col(field) == operand)
            elif operator == "$ne":
                rows = rows.where(F.col(field).isNull() | (F.col(field) != operand))
            else:
                raise ValueError(f"unknown operator {operator}")
        else:
            rows = rows.where(F.col(field) == value)
    return rows


def nearest_to(
    vector: list[float], base: DataFrame, k: int, *, base_id: str = "id", where: dict | None = None,
    embedding: str = "embedding",
) -> DataFrame:
    """Top-k rows for one vector: a projection and a bounded sort, no join at all."""
    from factloom.functions.vectors import cosine_distance

    rows = filter_metadata(base, where or {})
    query = unit_vector(F.array(*[F.lit(float(x)) for x in vector]))
    distance = F.round(cosine_distance(unit_vector(F.col(embedding)), query), DISTANCE_DIGITS)
    return rows.withColumn("distance", distance).orderBy("distance", base_id).limit(k)


def collection_size(base: DataFrame) -> DataFrame:
    return base.agg(F.count("*").alias("size"))
