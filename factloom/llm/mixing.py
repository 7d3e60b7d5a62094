"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule of weights over training time; its integral up to a time is the words the
source has been asked for by then. Inverting that demand gives every document copy its training
position, and a range sort by position gives the order of training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import ranked, spread_key, with_running_sum, word_count
from factloom.session import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source is repeated at most so often.
MAX_REPEATS = 3
#: Slope of each weight class over time: at 0.5 a source goes from half its mean rate to 1.5 times it.
SLOPES = (-0.5, 0.0, 0.5)


def _cycle(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target, slope`` from (source, size) rows.

    Sources share all words by weight; a target stops at ``max_repeats`` times its source's size and the
    excess is shared anew among the others. The level that does so is found by passes over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = ranked(totals, F.col("source").asc_nulls_last(), "place")
    totals = materialize(
        totals.select("source", "source_size", _cycle(weights, F.col("place")).alias("w"), _cycle(slopes, F.col("place")).alias("slope")),
        "sources",
    )
    most = F.col("source_size") * max_repeats
    level, before = 0.0, -1.0
    while level != before:
        capped = most < F.lit(level) * F.col("w") if before >= 0 else F.lit(False)
        words, held, weight = totals.agg(
            F.sum("source_size"), F.sum(F.when(capped, most).otherwise(0)), F.sum(F.when(~capped, F.col("w")).otherwise(0.0))
        ).first()
        if not words:
            break
        before, level = level, (words - held) / weight if weight else level
    target = F.least(most.cast("double"), F.lit(level) * F.col("w"))
    return totals.select("source", "source_size", target.alias("target"), "slope")


def demand_time(share: Column, slope: Column) -> Column:
    """Time in [0, 1] by which a source has been asked for ``share`` of its target.

    The rate is ``1 + slope * (2 t - 1)``; its integral ``slope * t^2 + (1 - slope) * t`` is inverted.
    """
    flat = 1.0 - slope
    root = (F.sqrt(flat * flat + 4.0 * slope * share) - flat) / (2.0 * slope)
    return F.when(slope == 0, share).otherwise(root)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", spread: tuple[Column, ...] = (), **options
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` for each row of ``docs``.

    A source is read in a fixed pseudo-random order (by id, or by the columns ``spread``), again and again until its target is met, so at most
    one document of a source is taken in part on its last pass. ``position`` is the training time of the
    first word taken, null where nothing is taken. Null or empty texts have size 0 and are never taken;
    null sources are a source of their own, the last. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        spread_key(*(spread or (F.col(id_col),))).alias("digest"),
    )
    rows = materialize(rows, "sizes")
    n = rows.count()
    targets = source_targets(rows, **options)
    placed = with_running_sum(rows, ["source"], "digest", F.col("size"), "before", "doc_id", "size", rows=n)
    named = targets.withColumnRenamed("source", "_source")
    full = placed.join(F.broadcast(named) if targets.count() <= 10_000 else named, F.col("source").eqNullSafe(F.col("_source")))
    quota = F.floor(F.col("target") + 0.5)
    size, whole = F.greatest(F.col("source_size"), F.lit(1)), F.greatest(quota, F.lit(1)).cast("double")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), quota % size - F.col("before")))
    taken = (F.floor(quota / size) * F.col("size") + rest).cast("long")
    share = F.col("before").cast("double") / whole
    return full.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.when(taken > 0, demand_time(share, F.col("slope"))).alias("position"), "source", "before", "slope",
    )


def copies_taken(mixed: DataFrame) -> DataFrame:
    """One row per copy taken: ``doc_id, copy, words, position``.

    Copy ``i`` of a document starts ``i`` source sizes later in its source's stream; the last copy may
    hold fewer words than the document.
    """
    copies = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rows = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    quota = F.greatest(F.floor(F.col("target") + 0.5), F.lit(1)).cast("double")
    share = (F.col("before") + F.col("copy") * F.col("source_size")).cast("double") / quota
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    return rows.select("doc_id", "copy", words.alias("words"), demand_time(share, F.col("slope")).alias("position"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`copies_taken`, range-sorted by position."""
    placed = copies_taken(mixed)
    return placed.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
