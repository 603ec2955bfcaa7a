"""Parquet tables of one folder, and durable intermediate tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; Catalyst prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` in at least ``least`` partitions (default: the session's parallelism).

    Only a table whose files give fewer tasks than there are cores is shuffled; a table of many files keeps
    its scan partitions, so nothing moves on a large input.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # shuffled already; counting its partitions would run it
        return df
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a temporary one; on a cluster that is an error, as no executor
    could read another's.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ragtide-"))
        folder = context.getCheckpointDir()
    return folder


def durable(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    Cuts the lineage, so a part that several branches read is computed once, and survives the loss of any
    executor. The folder of each table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ragtide-{uuid.uuid4().hex}"
    (df.repartition(*keys) if keys else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
    discard_at_end(spark, path)
    got = spark.read.schema(df.schema).parquet(path)
    got._durable_path = path
    return got


def release(df: DataFrame) -> None:
    """Deletes the table of ``durable`` now; nothing that is still to be computed may read it. For loops that write a table a round."""
    path = getattr(df, "_durable_path", None)
    if path is not None:
        spark = df.sparkSession
        _delete(spark, path)
        _OWNED[id(spark)] = [(s, p) for s, p in _OWNED.get(id(spark), []) if p != path]


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage now: Spark deletes the shuffle files of a job once nothing refers to its plan, but a driver with room to spare seldom looks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Folders that are still to be deleted, by session.
_OWNED: dict[int, list[tuple[SparkSession, str]]] = {}


def discard_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends, or with ``discard``."""
    if not _OWNED:
        atexit.register(discard)
    _OWNED.setdefault(id(spark), []).append((spark, path))


def discard(spark: SparkSession | None = None) -> None:
    """Deletes the intermediates of a session (or of all) now; for long sessions, once the results that were built on them are written."""
    for key in [id(spark)] if spark is not None else list(_OWNED):
        for owner, path in _OWNED.pop(key, []):
            _delete(owner, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass
