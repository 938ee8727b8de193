"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import ensure_checkpoint_dir

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder.

    On a cluster the package is installed, or at the same path, on every machine.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([root, known] if known else [root])


def word_count(text: Column) -> Column:
    """Words of a text as a long; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_key(*columns: Column) -> list[Column]:
    """128 bits that stand for the values of a row; equal rows have equal keys, and a null differs from any text."""
    marked = [x for c in columns for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    return [F.xxhash64(*marked).alias("__k1"), F.xxhash64(F.lit("2"), *marked).alias("__k2")]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table written to the shared checkpoint folder, and the table's path.

    The copy outlives executors. Unlike a checkpoint it carries no plan facts from
    round to round, which would make planning slower with every iteration.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """A stored frame that stays until the shared folder is cleared."""
    return stored(df)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


__all__ = ["WORD", "discard", "durable", "is_empty", "reach_workers", "row_key", "stored", "table", "word_count"]
