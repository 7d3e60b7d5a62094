"""Agreement clusters (connected components over corroborating edges) and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.session import materialize


#: Pairs up to which the minima of a round are broadcast, and pairs that one task of a round may hold.
BROADCAST_PAIRS, TASK_PAIRS = 200_000, 100_000


def _stars(pairs: DataFrame, upward: bool, n: int) -> DataFrame:
    """One star step on ``n`` (u, v) pairs: link every neighbour to the smallest one.

    ``upward`` relinks the larger neighbours (large star), else the smaller ones (small star). The
    minimum is a combinable aggregate joined back, so a hub's neighbour list is never collected.
    """
    if upward:
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    small, tasks = n <= BROADCAST_PAIRS, 1 + n // TASK_PAIRS
    if small:
        smallest = F.broadcast(smallest.coalesce(tasks))
    linked = around.join(smallest, "u")
    if upward:
        moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            linked.select("u", F.col("m").alias("v"))
        )
    moved = moved.where(F.col("u") != F.col("v")).distinct()
    return moved.coalesce(tasks) if small else moved


def components(pairs: DataFrame) -> DataFrame:
    """(vertex, root) for the connected vertices, by alternating stars (Kiveris et al., 2014).

    Needs a logarithmic number of rounds, also for long chains. Each round is written to the
    shared folder; the loop ends when a round changes nothing.
    """

    def state(rows: DataFrame) -> tuple:
        digest = F.xxhash64("u", "v")
        seen = rows.agg(
            F.count("*"), F.sum(F.pmod(digest, F.lit(1 << 40))), F.sum(F.pmod(F.shiftright(digest, 24), F.lit(1 << 38)))
        )
        return tuple(seen.first())

    current = pairs.toDF("u", "v").where(F.col("u") != F.col("v")).distinct()
    current = materialize(current, "pairs")
    before = state(current)
    while before[0]:
        current = materialize(_stars(_stars(current, True, before[0]), False, before[0]), "stars")
        after = state(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return members.unionByName(roots)


def agreement_clusters(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, cluster_id`` for every fact; a cluster is named by its smallest fact id.

    Only corroborating edges between known facts count; other facts are clusters of one.
    """
    ids = facts.select("id")
    pairs = edges.where(F.col("relation") == "corroborate").select("fact_a_id", "fact_b_id")
    for column in ("fact_a_id", "fact_b_id"):
        pairs = pairs.join(ids.withColumnRenamed("id", column), column, "left_semi")
    return clusters_of(facts, components(pairs.select("fact_a_id", "fact_b_id")))


def clusters_of(facts: DataFrame, found: DataFrame) -> DataFrame:
    """``id, cluster_id`` for every fact from the (vertex, root) of those that are linked."""
    ids = facts.select("id")
    return ids.join(found.withColumnRenamed("vertex", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("cluster_id")
    )


def cluster_labels(clusters: DataFrame, facts: DataFrame, order: str = "id") -> DataFrame:
    """Size and label of each cluster: the claim of the most confident member, first on ties."""
    rows = clusters.join(facts.select("id", "claim_text", "confidence", F.col(order).alias("_order")), "id")
    best = F.min_by("claim_text", F.struct((-F.col("confidence")).alias("c"), "_order"))
    return rows.groupBy("cluster_id").agg(best.alias("label"), F.max("confidence").alias("confidence"), F.count("*").alias("size"))
