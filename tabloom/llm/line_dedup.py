"""Removal of passages of repeated lines by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import durable, row_key

#: Lines in a window.
WINDOW = 3


def windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(order, at, hash) of every run of consecutive lines that holds a word."""
    lines = F.split(F.coalesce("__text", F.lit("")), "\n", -1)
    split = keyed.select("order", lines.alias("lines")).filter(F.size("lines") >= window)
    runs = split.select("order", "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - (window - 1))).alias("at"))
    whole = F.array_join(F.slice("lines", F.col("at"), window), "\n")
    return runs.select("order", "at", whole.alias("whole")).filter(F.rlike("whole", F.lit(r"[^\x20\x09-\x0D]"))).select(
        "order", "at", F.unhex(F.md5(F.col("whole").cast("binary"))).alias("hash")
    )


def without_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of docs with repeated passages taken out of ``text``, and ``n_lines``, ``n_removed``.

    Windows are counted over the whole corpus. The first occurrence of a window,
    by document id (nulls last), MD5 of the text and place, stays; every later one covers its
    lines, and all covered lines go. So a passage of at least three lines stays
    once, in its first document. Texts of fewer lines and windows without a word
    are left alone; a missing text stays missing. Rows equal in id and text count
    as one document and come out alike. Columns named like the two counts are
    replaced. A frequent window is counted in partial sums, and the join that
    marks its occurrences can be split.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.col("__text").cast("binary"))).alias("md5"),
        F.col("__k1").alias("k1"), F.col("__k2").alias("k2"),
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__d"),
        F.col("text").alias("__text"),
        *row_key(F.col("doc_id"), F.col("text")),
        "doc_id",
    ).withColumn("order", order)
    found = durable(windows(keyed, window))
    place = F.struct("order", "at")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    later = found.join(first.select("hash", "first"), "hash").filter(place > F.col("first"))
    covered = (
        later.select(F.col("order.k1").alias("__k1"), F.col("order.k2").alias("__k2"), F.explode(F.sequence(F.col("at"), F.col("at") + (window - 1))).alias("line"))
        .groupBy("__k1", "__k2")
        .agg(F.collect_set("line").alias("gone"))
    )
    lines = F.split("__text", "\n", -1)
    joined = keyed.select("__d", "__text", "__k1", "__k2").join(covered.hint("shuffle_hash"), ["__k1", "__k2"], "left")
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(F.col("__lines"), i)), "\n")
    )
    counted = joined.withColumn("__lines", lines).select(
        "__d",
        text.alias("__new"),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    columns = [F.col("__new").alias("text") if c == "text" else F.col(f"__d.`{c}`").alias(c) for c in keep]
    return counted.select(*columns, F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_removed", F.lit(0)).alias("n_removed"))
