"""Session defaults and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PART_BYTES = 64 * 1024 * 1024


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster, or a scratch one on a local master only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):  # not local-cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tabloom-ckpt-")
    sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder.

    Used where a frame is read many times (model search, neighbour search):
    the copy outlives executors, so a lost one does not replay the lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """A frame as a table in the shared checkpoint folder, and its path, for ``discard`` once nothing reads it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored_spread(df: DataFrame) -> tuple[DataFrame, str]:
    """The same, in about a part per core where the frame itself has fewer parts and several rows.

    For few rows that are much work each; a row is dealt as it is.
    """
    kept, path = stored(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    # a scan of stored files: nothing runs to tell its parts
    if kept.rdd.getNumPartitions() >= cores or len(kept.select(kept.columns[0]).limit(2).collect()) < 2:
        return kept, path
    spread, after = stored(kept.repartition(cores))
    discard(df.sparkSession, path)
    return spread, after


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept_spread(df: DataFrame) -> DataFrame:
    """Keep a frame that a fit will pass over many times, in at least one part per core.

    A table read from few files would otherwise train on few cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # the plan's own size estimate decides; nothing runs for it, and only a small frame is dealt anew
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    kept = (df.repartition(cores) if size < cores * _PART_BYTES else df).persist()
    kept.count()
    return kept
