"""What a written table was shuffled for leaves the disk with the write."""

import os

from pyspark.sql import functions as F

from factloom.session import materialize


def _shuffle_files(spark) -> set[str]:
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for root in folder for _, _, names in os.walk(root) for name in names if name.startswith("shuffle_")}


def test_shuffle_files_of_a_written_table_are_deleted(spark):
    before = _shuffle_files(spark)
    rows = spark.range(10_000).repartition(8, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    stored = materialize(rows, "counts")
    made = _shuffle_files(spark) - before
    assert not made
    assert rows.count() == stored.count() == 100 and rows.agg(F.sum("n")).first()[0] == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
