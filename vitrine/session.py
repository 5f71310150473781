"""Session settings that let Spark adapt to skew and size at run time."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state of streams beyond the executors' heap, and the only store with timers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a union whose parts AQE has coalesced to different numbers of partitions must not pass for co-partitioned (Spark 4.1)
    "spark.sql.unionOutputPartitioning": "false",
    # long expressions are built by the thousand: no call-site capture per column
    "spark.sql.dataFrameQueryContext.enabled": "false",
    # Arrow batches of wide embedding rows stay a few MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session that was built elsewhere.

    Functions of this package travel to the Python workers by value, so executors need
    no copy of the package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Spread a table of few file splits over all cores before costly per-row work.

    Decided from the plan, without running it: where the scan already has a split per
    core, as any large table has, the table is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode, where none is named, a private one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        configured = tempfile.mkdtemp(prefix="vitrine-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What the jobs inside shuffle is deleted as each of them ends."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def written(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()``, written to the checkpoint folder; what its jobs shuffled is deleted as each of them ends."""
    checkpoint_dir(spark)
    with dropping_shuffles(spark):
        return build().checkpoint()


def local_session(name: str = "vitrine", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
