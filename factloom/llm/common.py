"""Helpers shared by the operators: column selection, words, distributed ranks and running sums."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.session import materialize

#: A word is a maximal run of anything but these six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def released() -> None:
    """Give memory that a task has freed back to the system, as its Python worker waits for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Pass at most ``rows`` rows at a time to Python in this session, as rows hold whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing names among the others cannot matter."""
    kept = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    return docs.select(*kept, *[F.col(c).alias(c) for c in more])


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_key(*columns: Column | str) -> Column:
    """Hex digest that gives rows a fixed pseudo-random order, the same in every run and engine."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in texts]))


def with_running_sum(
    df: DataFrame, group: Sequence[str], digest: str, value: Column, name: str, *ties: str, rows: int | None = None
) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one in its group, ordered by the hex ``digest``.

    Three levels: totals of digest prefixes, running sums over at most 4096 prefixes at a time, and the
    rows of one prefix. So a group that holds a third of all rows is cut into thousands of windows; the
    prefix is long enough for about a thousand rows in each.
    """
    group = list(group)
    rows = df.count() if rows is None else rows
    digits = max(1, len(f"{max(1, rows // 1024):x}"))
    lead = f"_{name}_lead"
    cut = df.withColumn(lead, F.substring(digest, 1, digits)).withColumn(f"_{name}_value", value)
    totals = cut.groupBy(*group, lead).agg(F.sum(f"_{name}_value").alias("_total"))
    offsets, level = None, digits
    # Running sums of prefixes: inside blocks of 3 hex digits, then over the blocks, and so on.
    while True:
        short = max(0, level - 3)
        parents = [*group, "_parent"]
        here = totals.withColumn("_parent", F.substring(lead, 1, short))
        before = Window.partitionBy(*parents).orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        if offsets is None:
            offsets = here.select(*group, lead, "_parent", "_before")
        else:
            up = here.select(*group, F.col(lead).alias("_child"), F.col("_parent").alias("_up"), F.col("_before").alias("_more"))
            on = [offsets[g].eqNullSafe(up[g]) for g in group] + [offsets["_parent"] == up["_child"]]
            joined = offsets.join(up, on)
            offsets = joined.select(
                *[offsets[g] for g in group], lead, F.col("_up").alias("_parent"), (F.col("_before") + F.col("_more")).alias("_before")
            )
        if short == 0:
            break
        totals = here.groupBy(*parents).agg(F.sum("_total").alias("_total")).withColumnRenamed("_parent", lead)
        level = short
    offsets = offsets.drop("_parent")
    inside = (
        Window.partitionBy(*group, lead).orderBy(digest, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = cut.withColumn("_inside", F.coalesce(F.sum(f"_{name}_value").over(inside), F.lit(0)))
    on = [cut[g].eqNullSafe(offsets[g]) for g in group] + [cut[lead] == offsets[lead]]
    return cut.join(offsets, on).select(*[cut[c] for c in df.columns], (F.col("_inside") + F.col("_before")).alias(name))


def ranked(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Number the rows from 0 in a global order without one task that sees them all.

    A range partitioning is written once; only the row count of each partition passes the driver.
    """
    dealt = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    stored = materialize(dealt, "ranked")
    sizes = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbered = stored.withColumn("_place", place).join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place") - 1).alias(name))
