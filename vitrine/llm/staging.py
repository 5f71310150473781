"""Tables written to the cluster's shared folder to cut lineage, and shared small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, prepare

#: Arrow batches stay small for long texts; unknown to older versions, where it has no effect.
BATCH_BYTES = 8 << 20
_written: list[str] = []
_tables: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """The session with this library's settings and bounded Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vitrine-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors."""
    return staged_at(df, shared_path(df.sparkSession, name))


def staged_at(df: DataFrame, path: str) -> DataFrame:
    """Like :func:`staged`, at a path of :func:`shared_path`, for tables that are dropped before the session's others."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        _written.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like :func:`staged`, in buckets of ``column``, so that joins on it later leave the table where it is."""
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"vitrine_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Delete what this process staged; call it when the results have been written."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        _delete(spark, _written.pop())


def words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_of_id(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def keep_columns(df: DataFrame, clashing: Iterable[str]) -> DataFrame:
    """Drop columns of the input that an operator is about to produce."""
    return df.drop(*clashing)
