"""Exact interpolated quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one buffer, and
``percentile_approx`` is not exact. Here values are counted per prefix, from the
leading digits on: first per sign and thirty-second of a power of two, then per
equal part of the range of values that holds a wanted rank. Every task counts
before anything moves, no row is multiplied, and as two different values fall
apart after a few passes, a rank cannot be missed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tabloom.operators.aggregate import long_form
from tabloom.session import discard, stored

_PARTS = 4096  # of a range, in each pass after the first
_STEPS = 32  # prefixes per power of two, in the first pass


def _prefix(x: Column) -> Column:
    """Sign and leading binary digits of a number as an integer that grows with it."""
    size = F.abs(x)
    steps = F.floor((F.log2(size) + 1100) * _STEPS)  # over zero for the least of doubles
    infinite = F.lit(1 << 20)
    code = F.when(size == 0, F.lit(0)).when(size == F.lit(float("inf")), infinite).otherwise(steps).cast("int")
    return F.when(F.isnan(x), 2 * infinite).when(x < 0, -code).otherwise(code)


def _spans(counts: DataFrame, within: Sequence[str]) -> DataFrame:
    """Places ``start`` to ``end`` of every part in the order of its key; a key has some thousand parts at most."""
    order = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("end", F.sum("k").over(order)).withColumn("start", F.col("end") - F.col("k"))
    return spans.drop("part")


def _narrowed(held: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Wanted ranks beside the parts of their key: the part that holds each one, and its place there."""
    left = F.col("rank") - F.col("start")
    return held.filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))).select(
        *keep,
        left.alias("rank"),
        # the first and the last row of a part are known without another pass
        F.when((left == F.col("k") - 1) & (left > 0), F.col("most")).otherwise(F.col("least")).alias("lo"),
        F.when(left == 0, F.col("least")).otherwise(F.col("most")).alias("hi"),
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., column, prob, n, value) for every group, column and probability.

    Missing values and rows with a missing group are left out; a group without
    values of a column has no row for it. NaN is above every number. The passes
    run when this is called, each a scan of the rows; the tables between them are
    deleted, the last one, two rows per group, column and probability, stays.
    """
    by, probs = list(by), [float(p) for p in probs]
    group = [*by, "column"]
    data = df
    for b in by:
        data = data.filter(F.col(b).isNotNull())
    values = long_form(data, columns, by, "double").filter(F.col("value").isNotNull())
    x = F.col("value")
    measures = [F.count("*").alias("k"), F.min("value").alias("least"), F.max("value").alias("most")]
    position = F.col("prob") * (F.col("n") - 1)
    counts = values.groupBy(*group, _prefix(x).alias("part")).agg(*measures)
    every = (
        _spans(counts, group)
        .withColumn("n", F.sum("k").over(Window.partitionBy(*group)))
        .withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
        .withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("rank", F.when(F.col("upper"), F.ceil(position)).otherwise(F.floor(position)))
    )
    keep = [*group, "n", "prob", "upper"]
    wanted, path = stored(_narrowed(every, keep))
    is_open = F.col("lo") < F.col("hi")
    while not wanted.filter(is_open).isEmpty():
        counts = _refined(values, wanted.filter(is_open), group, 2 * len(probs)).agg(*measures)
        asked = wanted.filter(is_open).select(*keep, "rank", F.col("lo").alias("floor"))
        narrowed = _narrowed(asked.join(_spans(counts, [*group, "floor"]), [*group, "floor"]), keep)
        past, (wanted, path) = path, stored(wanted.filter(~is_open).unionByName(narrowed))
        discard(df.sparkSession, past)
    a, b = F.min(F.when(~F.col("upper"), F.col("lo"))), F.min(F.when(F.col("upper"), F.col("lo")))
    picked = wanted.groupBy(*group, "prob", "n").agg(a.alias("a"), b.alias("b"))
    between = F.col("a") + (F.col("b") - F.col("a")) * (position - F.floor(position))
    # equal ends are the value itself, also where they are infinite
    return picked.select(*group, "prob", "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("value"))


def _refined(values: DataFrame, wanted: DataFrame, group: Sequence[str], most: int) -> GroupedData:
    """Rows of the ranges that hold an open rank, grouped by equal parts of their range."""
    # one row per group and column: its open ranges, which are disjoint
    ranges = (
        wanted.groupBy(*group)
        .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
        .select(*group, *[F.get("spans", F.lit(j))[e].alias(f"{e}{j}") for j in range(most) for e in ("lo", "hi")])
    )
    # the ranges come from a stored table, so Spark broadcasts them only if that is small
    near = values.join(ranges, list(group))
    inside = [F.col("value").between(F.col(f"lo{j}"), F.col(f"hi{j}")) for j in range(most)]
    lo = F.coalesce(*[F.when(i, F.col(f"lo{j}")) for j, i in enumerate(inside)])
    hi = F.coalesce(*[F.when(i, F.col(f"hi{j}")) for j, i in enumerate(inside)])
    share = (F.col("value") - F.col("floor")) / (F.col("top") - F.col("floor"))
    part = F.least(F.floor(share * _PARTS).cast("int"), F.lit(_PARTS - 1))
    cut = near.select(*group, "value", lo.alias("floor"), hi.alias("top")).filter(F.col("floor").isNotNull())
    return cut.groupBy(*group, "floor", part.alias("part"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the median of each column, missing values left out."""
    return exact_quantiles(df, columns, [0.5]).select("column", "value")
