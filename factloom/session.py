"""Session defaults and the one place that writes intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytecode of a generated method up to which the JVM compiles it; larger ones would be interpreted for every row.
_METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def build_session(master: str = "local[8]", app_name: str = "factloom", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Small local tables: many small splits, as the stages are bound by CPU and not by I/O.
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session (tests) falls back to a fresh temporary folder; on a cluster a
    missing setting is an error, because executors do not share local disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SCRATCH[app]


@contextlib.contextmanager
def own_write(spark: SparkSession) -> Iterator[None]:
    """Settings of the package's own writes.

    They delete the shuffle files of their plan as they end, not once the driver collects its garbage, and split
    a stage whose generated method the JVM would not compile.
    """
    limit = int(spark.conf.get(_METHOD_LIMIT))
    settings = {_FREE_SHUFFLES: "true", _METHOD_LIMIT: str(min(COMPILED_BYTES, limit))}
    before = {_FREE_SHUFFLES: spark.conf.get(_FREE_SHUFFLES, "false"), _METHOD_LIMIT: str(limit)}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table.

    Used where a result is read more than once or a loop must cut its lineage. The scan keeps
    column pruning and pushdown, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/factloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with own_write(spark):
        df.write.parquet(path, compression="zstd")
    stored = spark.read.schema(df.schema).parquet(path)
    stored.written_to = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, once what was made of them is written.

    Only the frames that ``materialize`` returned count; others, such as frames made of them, are left.
    """
    for table in tables:
        path = vars(table).get("written_to")
        if path:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` has written for this application; results read from them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/factloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table with fewer splits than cores, ahead of work bound by CPU.

    A table with enough splits, as any large one, is returned as it is: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
