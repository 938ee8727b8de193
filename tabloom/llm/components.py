"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, is_empty, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Each round hooks every node to its smallest smaller neighbour, flattens the
    hooks by pointer jumping and contracts the links to the roots, so the number
    of rounds is logarithmic. A node with very many links is met by partial
    aggregates and by joins whose large partitions can be split.
    """
    spark = links.sparkSession
    links, links_path = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    nodes = links.select(F.col("hi").alias("node")).union(links.select("lo")).distinct()
    labels, labels_path = stored(nodes.withColumn("root", F.col("node")))
    while not is_empty(links):
        hooks, hooks_path = _flat(*stored(links.groupBy("hi").agg(F.min("lo").alias("up"))))
        new_labels, new_labels_path = stored(_moved(labels, "root", hooks))
        new_links, new_links_path = stored(
            _moved(_moved(links, "hi", hooks), "lo", hooks)
            .filter("hi <> lo")
            .select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
            .distinct()
        )
        discard(spark, links_path, labels_path, hooks_path)
        links, links_path, labels, labels_path = new_links, new_links_path, new_labels, new_labels_path
    discard(spark, links_path)
    return labels


def _moved(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace a node column by the node it is hooked to."""
    to = hooks.select(F.col("hi").alias("__from"), F.col("up").alias("__to"))
    out = df.join(to, F.col(column) == F.col("__from"), "left")
    return out.withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def _flat(hooks: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Follow hooks until each points at a node that is not hooked itself."""
    while True:
        up = hooks.select(F.col("hi").alias("__from"), F.col("up").alias("__to"))
        nxt, nxt_path = stored(
            hooks.join(up, F.col("up") == F.col("__from"), "left").select(
                "hi", F.coalesce("__to", "up").alias("up"), F.col("__to").isNotNull().alias("moved")
            )
        )
        discard(hooks.sparkSession, path)
        hooks, path = nxt.select("hi", "up"), nxt_path
        if is_empty(nxt.filter("moved")):
            return hooks, path
