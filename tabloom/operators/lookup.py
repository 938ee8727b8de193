"""Value -> statistic joins whose broadcast side has a checked size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(table: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a table is within the broadcast bound, by rows and key bytes."""
    size = table.agg(
        F.count("*").alias("n"),
        F.coalesce(
            F.sum(sum((F.octet_length(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys), F.lit(0))),
            F.lit(0),
        ).alias("b"),
    ).first()
    return size["n"] <= MAX_BROADCAST_ROWS and size["b"] <= MAX_BROADCAST_BYTES


def lookup(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", small: bool | None = None
) -> DataFrame:
    """Join ``table``, broadcasting it only when its size was checked.

    A larger table is joined by shuffle. Rows of a left join with a missing key
    match nothing, so they are kept out of it; the large partitions of frequent
    keys are split by adaptive execution.
    """
    on = list(on)
    if small is None:
        small = is_small(table, on)
    if small:
        return df.join(F.broadcast(table), on, how)
    if how != "left":
        return df.join(table, on, how)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    found = df.filter(known).join(table, on, "left")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in on]
    missing = df.filter(~known).select(*on, *[c for c in df.columns if c not in on], *more)
    return found.unionByName(missing)
