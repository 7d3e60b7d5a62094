"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random directions, shifted, and ordered along a Hilbert curve, several
times. Spark range-partitions each order; rows near a query in any order are its candidates, and their
true distances are merged. Pilot queries, searched exactly, set the width of the window, so that recall
holds at every size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.common import ranked
from factloom.session import materialize

ORDERS, DIMENSIONS, BITS, SEED = 32, 12, 5, 7
#: Pilot queries at most, the share of their neighbours that the window must reach, and its least width.
PILOTS, TARGET, LEAST_WINDOW = 128, 0.97, 64


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer point on the Hilbert curve (Skilling's transform); bits times dimensions below 64."""
    x = points.T.astype(np.uint64)
    n, one = len(x), np.uint64(1)
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > one:
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, np.uint64(0)) ^ swap
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > one:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        packed = [np.asarray(v, np.float64).tobytes() for v in batch["vector"]]
        yield pd.DataFrame({"id": batch["id"], "vector": packed})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _moments(vectors: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance over all rows; each task sends one number for each cell."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if len(batch):
                x = np.c_[np.ones(len(batch)), _matrix(batch["vector"])]
                total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = vectors.select("vector").mapInPandas(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros((size + 1) ** 2)
    for r in cells.collect():
        total[r["cell"]] = r["value"]
    total = total.reshape(size + 1, size + 1)
    n = max(1.0, total[0, 0])
    mean = total[0, 1:] / n
    return mean, total[1:, 1:] / n - np.outer(mean, mean)


def _nearest(queries: np.ndarray, names: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest rows of ``base`` for each query, ties to the smaller id."""
    out = []
    rough = (base * base).sum(axis=1) - 2 * queries @ base.T
    size = (queries * queries).sum(axis=1)
    if within is not None:
        rough = np.where(within, rough, np.inf)
    for i, name in enumerate(names):
        allowed = np.flatnonzero(np.isfinite(rough[i]))
        if len(allowed) > k:
            # The quick form only preselects; its error is far below the slack.
            limit = np.partition(rough[i][allowed], k - 1)[k - 1] + 1e-6 * (1 + size[i] + np.abs(rough[i][allowed]).max())
            allowed = allowed[rough[i][allowed] <= limit]
        far = np.sqrt(((base[allowed] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[allowed], far))[:k]
        out.append(pd.DataFrame({"query": name, "rep": ids[allowed][best], "score": far[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})


def nearest(
    base: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", orders: int = ORDERS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each usable row that ``is_query`` picks, its k nearest others.

    Score is the Euclidean distance in double precision, ties go to the smaller id. Rows with a null id,
    and vectors that are null, zero, not finite or not of the usual length take no part. Equal vectors are
    searched once and keep their k + 1 smallest ids, which is all that an answer can need; a row repeated
    with its id counts once. With few rows a query gets as many as there are; an empty table gives no rows.
    """
    rows = base.withColumn("_query", is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), "_query")
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 1
    rows = rows.where(F.size("vector") == size)
    packed = materialize(rows.select("id", "vector").mapInPandas(_pack, "id long, vector binary"), "packed")
    copies = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = packed.distinct().withColumn("_nth", copies).where(F.col("_nth") <= k + 1)
    distinct = few.groupBy("vector").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = materialize(distinct, "vectors")
    total = distinct.count()
    asked = rows.where("_query").select("id").distinct().join(packed.distinct(), "id")
    asked = asked.join(distinct.select("vector", "rep"), "vector").select(F.col("id").alias("query_id"), "rep")
    asked = materialize(asked.distinct(), "queries")
    mean, cover = _moments(distinct, size)
    maker = np.random.default_rng(SEED)
    width = min(DIMENSIONS, size)
    turns = [np.linalg.qr(maker.normal(size=(size, width)))[0] for _ in range(orders)]
    shifts = [maker.random(width) for _ in range(orders)]
    spreads = [np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", t, cover, t), 1e-18)) for t in turns]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["vector"]) - mean
            for i in range(orders):
                unit = np.clip(0.5 + x @ turns[i] / (6 * spreads[i]), 0, 1)
                cells = np.minimum((unit + shifts[i]) / 2 * (1 << BITS), (1 << BITS) - 1)
                yield pd.DataFrame({"order": np.int32(i), "key": hilbert_keys(cells.astype(np.uint64), BITS), "rep": batch["rep"]})

    lines = distinct.select("rep", "vector").mapInPandas(keys, "order int, key long, rep long")
    placed = ranked(lines, F.struct("order", "key", "rep"), "place")
    # Every order has each vector once, so places within an order follow from the global ones.
    placed = materialize(placed.select("order", "rep", (F.col("place") - F.col("order") * F.lit(total)).alias("place")), "places")
    wanted = materialize(asked.select("rep").distinct(), "wanted")
    window = _window(distinct, wanted, placed, k)

    query = placed.join(wanted, "rep").withColumn("block", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("place") - window) / window)), F.floor((F.col("place") + window) / window))))
    members = placed.withColumn("block", F.floor(F.col("place") / window)).withColumn("asks", F.lit(False))
    met = members.unionByName(query.withColumn("asks", F.lit(True))).join(distinct.select("rep", "vector"), "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        own, others = group[asks], group[~asks]
        if not len(own) or not len(others):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        near = np.abs(own["place"].to_numpy()[:, None] - others["place"].to_numpy()[None]) <= window
        return _nearest(_matrix(own["vector"]), own["rep"].to_numpy(), _matrix(others["vector"]), others["rep"].to_numpy(), k + 1, near)

    found = met.groupBy("order", "block").applyInPandas(compare, "query long, rep long, score double")
    best = found.groupBy("query", "rep").agg(F.min("score").alias("score"))
    best = best.join(distinct.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    lists = best.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    lists = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("list"))
    answer = asked.join(lists, asked["rep"] == lists["query"]).select(
        "query_id", F.posexplode(F.slice(F.filter("list", lambda r: r["vec_id"] != F.col("query_id")), 1, k))
    )
    return answer.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def _window(distinct: DataFrame, wanted: DataFrame, placed: DataFrame, k: int) -> int:
    """Least window that reaches the target share of the true neighbours of the pilots."""
    pilots = wanted.orderBy(F.xxhash64("rep"), "rep").limit(PILOTS).join(distinct.select("rep", "vector"), "rep").toPandas()
    if not len(pilots):
        return LEAST_WINDOW
    pilots = pilots.sort_values("rep")
    points, names = _matrix(pilots["vector"]), pilots["rep"].to_numpy()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.iloc[at : at + 8192]
                yield _nearest(points, names, _matrix(part["vector"]), part["rep"].to_numpy(), k + 1)

    hits = distinct.select("rep", "vector").mapInPandas(search, "query long, rep long, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    hits = hits.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("query", "rep").toPandas()
    ids = pd.unique(np.r_[hits["query"], hits["rep"]]).tolist()
    known = placed.sparkSession.createDataFrame([(int(i),) for i in ids], "rep long")
    at = placed.join(F.broadcast(known), "rep").toPandas().pivot(index="rep", columns="order", values="place")
    gaps = np.abs(at.loc[hits["query"]].to_numpy() - at.loc[hits["rep"]].to_numpy()).min(axis=1)
    gaps = gaps[(hits["query"] != hits["rep"]).to_numpy()]
    return max(LEAST_WINDOW, int(np.quantile(gaps, TARGET, method="higher")) if len(gaps) else 0)
