"""Hard negatives by slots of the score axis.

An anchor's positives set windows of allowed scores, and windows overlap. Their upper limits cut the axis
into disjoint slots; each block of rows keeps only the k best of every slot, blocks are combined the same
way, and a merge from the lowest slot upwards gives the k best below every upper limit at once: one pass
over the rows answers all windows of an anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.session import materialize

#: Rows aimed at in one block of anchors and in one block of candidates: a task holds one of each.
ANCHOR_BLOCK, ROW_BLOCK = 2048, 8192
#: Products are exact in doubles below this bound; larger numbers are multiplied as Python integers.
EXACT = 2**53
LONG = 2**63 - 1

_FOUND = "anchor_id long, slot int, score long, vec_id long"
_ARROW = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def whole_parts(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as long; beyond the range of long its limits."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and all components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return (np.concatenate(flat) if flat else np.zeros(0, np.int64)).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` and ``b``; beyond the range of long its limits."""
    most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` the k with the highest scores, ties to the smaller id."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, score: Callable) -> DataFrame:
    """Every block of anchors meets every block of rows of its size once; ``score`` sees one pair of blocks."""
    a, r = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    left = anchors.withColumn("_a", F.pmod(F.xxhash64(F.lit("a"), "vec_id"), F.lit(a)))
    left = left.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    right = rows.withColumn("_r", F.pmod(F.xxhash64(F.lit("r"), "vec_id"), F.lit(r)).cast("int"))
    right = right.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))))
    keys = ("_a", "_r", "_size")
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides read one table: tell their columns apart
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _FOUND)


def _combined(found: DataFrame, k: int) -> DataFrame:
    """The k best of every slot of an anchor over all blocks; Spark cuts to k before the shuffle too."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def _table(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    sizes = [len(p[2]) for p in parts]
    columns = [
        np.repeat(np.array([p[0] for p in parts], np.int64), sizes), np.repeat(np.array([p[1] for p in parts], np.int32), sizes),
        *[np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (2, 3)],
    ]
    return pa.table(columns, schema=_ARROW)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are exact integer inner products of ``floor(scale * x)``. An anchor's positives are its
    ``positives`` best other rows of its label; for each of them its ``negatives`` best rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score`` follow, the higher score
    first, ties to the smaller id; fewer if there are fewer, none below a negative positive score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; zero and
    empty vectors do, with scores of 0. A row is compared with rows of its own number of components only. A
    row repeated with its id counts once; of different rows with one id the least (label, then components)
    counts. A label or a vector that a third of all rows share needs no treatment of its own, as blocks are
    dealt by id. An empty table, or one without anchors, gives no rows; other columns are not read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), is_anchor.alias("_asks")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", whole_parts(F.col("v"), scale))
    one = F.min(F.struct("label", "v", "_asks")).alias("_row")
    rows = rows.groupBy("vec_id").agg(one).select("vec_id", "_row.*").withColumn("_size", F.size("v"))
    # Labels become numbers, so that tasks compare integers whatever type they have.
    rows = rows.withColumn("label", F.xxhash64("label"))
    rows = materialize(rows, "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("_asks").alias("a")).first()
    anchors = rows.where("_asks").drop("_asks")
    base = rows.drop("_asks")

    def same_label(own: pa.Table, others: pa.Table) -> pa.Table:
        parts: list = []
        ids, labels = (others[c].to_numpy() for c in ("vec_id", "label"))
        names, wanted = (own[c].to_numpy() for c in ("vec_id", "label"))
        x, y = _matrix(own["v"], len(names)), _matrix(others["v"], len(ids))
        for label in np.unique(wanted):
            asks, there = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
            if not len(there):
                continue
            scores = products(x[asks], y[there])
            for i, ask in enumerate(asks):
                best = _best(scores[i], ids[there], np.flatnonzero(ids[there] != names[ask]), positives)
                parts.append((names[ask], 0, scores[i][best], ids[there][best]))
        return _table(parts)

    liked = _combined(_cells(anchors, base, counts["a"], counts["n"], same_label), positives)
    liked = materialize(liked.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "nth"), "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    top = F.floor(score * high / 100).cast("long")
    bottom = F.ceil(score * low / 100).cast("long")
    windows = liked.withColumn("top", top).withColumn("bottom", bottom).where("bottom <= top")
    # Distinct upper limits, ascending: slot i holds the scores above limit i - 1 up to limit i.
    limits = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_set("top")).alias("tops"), F.min("bottom").alias("least"))
    asking = anchors.join(limits, anchors["vec_id"] == limits["anchor_id"]).drop("anchor_id")

    def slots(own: pa.Table, others: pa.Table) -> pa.Table:
        parts: list = []
        ids, labels = (others[c].to_numpy() for c in ("vec_id", "label"))
        names, wanted, least = (own[c].to_numpy() for c in ("vec_id", "label", "least"))
        tops = own["tops"].to_pylist()
        x, y = _matrix(own["v"], len(names)), _matrix(others["v"], len(ids))
        for at in range(0, len(names), 256):  # a bounded slice of the matrix at a time
            if not len(ids):
                break
            scores = products(x[at : at + 256], y)
            for i, row in enumerate(scores, at):
                there = np.flatnonzero((labels != wanted[i]) & (row >= least[i]) & (row <= tops[i][-1]))
                slot = np.searchsorted(tops[i], row[there])
                for j in range(len(tops[i])):
                    best = _best(row, ids, there[slot == j], negatives)
                    if len(best):
                        parts.append((names[i], j, row[best], ids[best]))
        return _table(parts)

    kept = _combined(_cells(asking, base, counts["a"], counts["n"], slots), negatives)
    # At most `positives` slots of `negatives` rows, so these lists are short.
    entries = kept.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("entries"))
    pairs = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score", "top", "bottom")).alias("pairs"))
    joined = pairs.join(entries, "anchor_id").join(limits.select("anchor_id", "tops"), "anchor_id").select("anchor_id", "tops", "pairs", "entries")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the lowest slot upwards, the k best of all slots so far answer the windows that end there."""
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                by_slot: dict[int, list] = {}
                for e in row["entries"]:
                    by_slot.setdefault(e["slot"], []).append((-e["score"], e["vec_id"]))
                so_far: list[tuple[int, int]] = []
                answers = {}
                for slot, limit in enumerate(row["tops"]):
                    # All scores of this slot are higher than any below it.
                    so_far = list(heapq.merge(sorted(by_slot.get(slot, [])), so_far))[:negatives]
                    answers[limit] = so_far
                for p in row["pairs"]:
                    inside = [(n, i) for n, i in answers[p["top"]] if -n >= p["bottom"]]
                    out += [(row["anchor_id"], p["positive_id"], rank, i, p["positive_score"], -n) for rank, (n, i) in enumerate(inside, 1)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return joined.mapInArrow(
        merge, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
