"""Exact ranks and running totals that never sort a whole group in one task.

A group may hold a third of all rows, so ``Window.partitionBy(group)`` alone is
one task's work. Both helpers split every group into order-preserving cells,
count the cells (map-side combined), carry the totals across the small table of
cells, and sort only within a cell.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_cell, hash_text

ROWS_PER_CELL = 500_000
_MAX_CELLS = 20_000
_FROM_START = Window.unboundedPreceding


def cell_splits(df: DataFrame, along: str, rows: int, rows_per_cell: int = ROWS_PER_CELL) -> list[float] | None:
    """Bounds of equal-depth cells over a numeric column, or None if one cell is enough.

    The bounds come from a mergeable sketch; being approximate they only vary
    the cell sizes, never a result.
    """
    if rows <= rows_per_cell:
        return None
    cells = min(_MAX_CELLS, 2 * math.ceil(rows / rows_per_cell))
    probs = [i / cells for i in range(1, cells)]
    edges = df.agg(F.percentile_approx(along, probs, 10 * cells).alias("e")).first()["e"]
    return [-math.inf, *sorted(set(edges)), math.inf]


def in_cells(df: DataFrame, along: str, splits: list[float]) -> DataFrame:
    """Add ``__cell``, the number of the cell a value falls in."""
    wide = df.withColumn("__along", F.col(along).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="__along", outputCol="__cell", handleInvalid="keep")
    return cut.transform(wide).drop("__along")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    along: str,
    sums: Mapping[str, Column],
    splits: list[float] | None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running totals over ``order`` within ``by``.

    ``along`` is the numeric column leading the order and ``splits`` its cells,
    from ``cell_splits``. Equal values share a cell, so callers aggregate ties
    first.
    """
    by = list(by)
    named = df.withColumns({f"__v_{n}": e for n, e in sums.items()})
    if splits is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(_FROM_START, 0)
        return named.withColumns({n: F.sum(f"__v_{n}").over(w) for n in sums}).drop(
            *[f"__v_{n}" for n in sums]
        )

    celled = in_cells(named, along, splits)
    if descending:
        celled = celled.withColumn("__cell", -F.col("__cell"))
    totals = celled.groupBy(*by, "__cell").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("__cell").rowsBetween(_FROM_START, -1)
    carried = totals.select(
        *by,
        "__cell",
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    within = Window.partitionBy(*by, "__cell").orderBy(*order).rowsBetween(_FROM_START, 0)
    out = celled.withColumns({n: F.sum(f"__v_{n}").over(within) for n in sums})
    out = out.join(carried, [*by, "__cell"])
    return out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).select(
        *df.columns, *sums.keys()
    )


def hash_cutpoints(
    df: DataFrame, key: str, seed: int, wanted: DataFrame, by: Sequence[str], small: bool, digits: int = 4
) -> DataFrame:
    """Digest of the row at each wanted 1-based rank of a group's hash order.

    ``wanted`` has the ``by`` columns, ``cut`` (a label) and ``position``; ``small``
    says whether its size was checked. The answer is one row per (group, cut), so
    a split at exact sizes needs no shuffle of the rows themselves: each row is
    compared with a text constant.
    """
    by = list(by)
    hint = F.broadcast if small else (lambda table: table)
    hashed = df.select(*by, hash_text(key, seed).alias("__h")).withColumn(
        "__cell", hash_cell(F.col("__h"), digits)
    )
    counts = hashed.groupBy(*by, "__cell").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy("__cell").rowsBetween(_FROM_START, 0)
    spans = counts.withColumn("__end", F.sum("__n").over(order)).withColumn(
        "__start", F.col("__end") - F.col("__n")
    )
    # the single cell of each group that contains the wanted rank
    hits = (
        spans.alias("s")
        .join(hint(wanted.alias("w")), _same(by, "s", "w") & _inside(), "inner")
        .select(*[F.col(f"s.{c}") for c in by], "w.cut", "w.position", "s.__cell", "s.__start")
    )
    inside = (
        hashed.alias("h")
        .join(hint(hits.alias("k")), _same([*by, "__cell"], "h", "k"), "inner")
        .select(*[F.col(f"h.{c}") for c in by], "k.cut", "k.position", "k.__start", "h.__h")
    )
    rank = Window.partitionBy(*by, "cut").orderBy("__h")
    return (
        inside.withColumn("__r", F.row_number().over(rank) + F.col("__start"))
        .filter(F.col("__r") == F.col("position"))
        .select(*by, "cut", F.col("__h").alias("digest"))
    )


def _same(columns: Sequence[str], left: str, right: str) -> Column:
    out = F.col(f"{left}.{columns[0]}").eqNullSafe(F.col(f"{right}.{columns[0]}"))
    for c in columns[1:]:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _inside() -> Column:
    return (F.col("w.position") > F.col("s.__start")) & (F.col("w.position") <= F.col("s.__end"))
