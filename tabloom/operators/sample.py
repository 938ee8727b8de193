"""Splits, folds, samples, weights and balancing in a reproducible hash order.

Rows are put in the order of ``md5(key:seed)``; the key must be unique. A split
at an exact size is a comparison of each row's digest with the digest at the
cut, so the rows themselves are never shuffled or ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_cell, hash_long, hash_text
from tabloom.operators.lookup import is_small
from tabloom.operators.ranks import hash_cutpoints

_ALL = "__all"
_REPEAT_CHUNK = 10_000


def _group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("__n"))


class HashCuts:
    """Cut positions in the hash order of each group, shared by every frame they are applied to.

    Each position is an expression over ``__n``, the group size, giving the
    0-based rank a cut starts at. Group sizes are counted once for all seeds.
    """

    def __init__(self, df: DataFrame, key: str, by: str | None):
        self.key, self.by = key, by
        self.keys = df.select(key, *([] if by is None else [by]), self._group().alias(_ALL))
        self.counts = _group_counts(self.keys, [_ALL]).persist()
        self.small = is_small(self.counts, [_ALL])
        self.digits = cell_digits(self.counts.agg(F.max("__n")).first()[0])

    def _group(self) -> Column:
        return F.lit(0) if self.by is None else F.col(self.by)

    def mark(self, df: DataFrame, seed: int, positions: Sequence[Column], output: str) -> DataFrame:
        """Add ``output``: how many cuts lie at or before the row."""
        cuts = self.counts.select(
            _ALL,
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("cut"), (p + 1).cast("bigint").alias("position"))
                        for i, p in enumerate(positions)
                    ]
                )
            ),
        )
        # a cut behind the last row of its group has no digest and marks nothing
        at = hash_cutpoints(self.keys, self.key, seed, cuts, [_ALL], self.small, self.digits)
        # one row per group, kept: every later pass over the rows compares with it
        digests = at.groupBy(_ALL).pivot("cut", list(range(len(positions)))).agg(F.first("digest")).persist()
        table = F.broadcast(digests) if self.small else digests
        rows = df.withColumn("__g", self._group()).alias("d")
        joined = rows.join(table.alias("c"), F.col("d.__g").eqNullSafe(F.col(f"c.{_ALL}")), "left")
        own = hash_text(F.col(f"d.{self.key}"), seed)
        passed = F.lit(0)
        for i in range(len(positions)):
            passed = passed + F.coalesce((own >= F.col(f"c.{i}")).cast("int"), F.lit(0))
        return joined.select(*[F.col(f"d.{c}") for c in df.columns], passed.alias(output))


def mark_by_rank(
    df: DataFrame, key: str, seed: int, positions: Sequence[Column], by: str | None, output: str
) -> DataFrame:
    return HashCuts(df, key, by).mark(df, seed, positions, output)


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ceil(share x rows) rows are in the test side."""
    size = F.ceil(F.col("__n") * test_share)
    marked = mark_by_rank(df, key, seed, [size], None, "__m")
    return marked.withColumn("is_test", F.col("__m") == 0).drop("__m")


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the rounded share of every class is in the test side."""
    size = F.round(F.col("__n") * test_share)
    marked = mark_by_rank(df, key, seed, [size], label, "__m")
    return marked.withColumn("is_test", F.col("__m") == 0).drop("__m")


def sides(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a split frame."""
    return (
        split.filter(~F.col("is_test")).drop("is_test"),
        split.filter(F.col("is_test")).drop("is_test"),
    )


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(fraction x rows) rows, without replacement."""
    marked = mark_by_rank(df, key, seed, [F.round(F.col("__n") * fraction)], None, "__m")
    return marked.filter(F.col("__m") == 0).drop("__m")


def _fold_starts(folds: int) -> list[Column]:
    return [F.ceil(F.col("__n") * i / folds) for i in range(1, folds)]


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int, seed: int = 42, output: str = "fold"
) -> DataFrame:
    """Add a fold number; within a class, fold sizes differ by at most one."""
    return mark_by_rank(df, key, seed, _fold_starts(folds), label, output)


def repeated_folds(
    df: DataFrame, key: str, label: str, folds: int, repeats: int, seed: int = 42
) -> DataFrame:
    """Add one fold column per repeat, ``fold_0``, ``fold_1``, ..., each with its own order."""
    cuts = HashCuts(df, key, label)
    for r in range(repeats):
        df = cuts.mark(df, seed + r, _fold_starts(folds), f"fold_{r}")
    return df


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows / (classes x class rows)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    rows, classes = counts.agg(F.sum("__n")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.select(label, (rows / (classes * F.col("__n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class."""
    known = df.filter(F.col(label).isNotNull())
    # one pass over the rows; the weights are read off the kept counts
    counts = known.groupBy(label).agg(F.count("*").alias("__n")).persist()
    small = is_small(counts, [label])
    rows, classes = counts.agg(F.sum("__n"), F.count("*")).first()
    weights = counts.select(label, (F.lit(rows) / (F.lit(classes) * F.col("__n"))).alias(output))
    return df.join(F.broadcast(weights) if small else weights, label, "left")


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = _group_counts(df.filter(F.col(label).isNotNull()), [label]).agg(F.min("__n")).first()[0]
    kept = mark_by_rank(df.filter(F.col(label).isNotNull()), key, seed, [F.lit(least)], label, "__m")
    return kept.filter(F.col("__m") == 0).drop("__m")


def cell_digits(rows: int | None) -> int:
    """Hex digits of the hash cells of a group, so that a cell holds ten thousand rows or so."""
    digits = 2
    while (rows or 0) > 10_000 * 16**digits and digits < 8:
        digits += 1
    return digits


def hash_ranked(df: DataFrame, key: str, label: str, seed: int, output: str, digits: int) -> DataFrame:
    """Add the 0-based rank within the class in hash order, class by class in hash cells."""
    hashed = df.withColumn("__h", hash_text(key, seed)).withColumn("__cell", hash_cell(F.col("__h"), digits))
    counts = hashed.groupBy(label, "__cell").agg(F.count("*").alias("__k"))
    before = Window.partitionBy(label).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(label, "__cell", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(label, "__cell").orderBy("__h")
    return (
        hashed.withColumn("__r", F.row_number().over(within) - 1)
        .join(starts, [label, "__cell"])
        .withColumn(output, F.col("__r") + F.col("__start"))
        .select(*df.columns, output)
    )


def drawn_rows(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Rows drawn with replacement to raise every class to the largest, with ``__times``.

    The draws are counted per drawn row before they meet the rows, so a class of
    ten rows raised to a billion moves ten counts, not a billion keys.
    """
    known = df.filter(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count("*").alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 0
    need = counts.select(label, "__n", (F.lit(most) - F.col("__n")).alias("__need")).filter(F.col("__need") > 0)
    small = is_small(need, [label])

    # draw d of a class takes the row whose rank is a hash of (class, d); chunks of draws are dealt out
    last = F.floor((F.col("__need") - 1) / _REPEAT_CHUNK)
    chunks = need.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(label, "__chunk")
    first = F.col("__chunk") * _REPEAT_CHUNK
    upto = F.least(first + _REPEAT_CHUNK, F.col("__need")) - 1
    draws = chunks.withColumn("__d", F.explode(F.sequence(first, upto)))
    text = F.concat(F.col(label).cast("string"), F.lit(":"), F.col("__d").cast("string"))
    drawn = (
        draws.withColumn("__rank", hash_long(hash_text(text, seed)) % F.col("__n"))
        .groupBy(label, "__rank")
        .agg(F.count("*").alias("__times"))
    )
    classes = need.select(label)
    short = known.join(F.broadcast(classes) if small else classes, label, "left_semi")
    ranked = hash_ranked(short, key, label, seed, "__rank", cell_digits(most))
    return ranked.join(drawn, [label, "__rank"]).select(*df.columns, "__times")


def oversample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class raised to the size of the largest by draws with replacement.

    Adds ``copy``: 0 for the row itself, 1, 2, ... for its drawn copies.
    """
    copies = repeat_rows(drawn_rows(df, key, label, seed), "__times", "copy", key)
    known = df.filter(F.col(label).isNotNull())
    return known.withColumn("copy", F.lit(0).cast("bigint")).unionByName(copies.select(*df.columns, "copy"))


def repeat_rows(df: DataFrame, times: str, output: str, key: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1.

    Two explodes with a shuffle between them: a row repeated very often becomes
    chunks that several tasks unfold.
    """
    last_chunk = F.floor((F.col(times) - 1) / _REPEAT_CHUNK)
    chunks = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    spread = chunks.repartition(key, "__chunk")
    first = F.col("__chunk") * _REPEAT_CHUNK
    last = F.least(first + _REPEAT_CHUNK, F.col(times))
    return spread.withColumn(output, F.explode(F.sequence(first + 1, last))).drop("__chunk", times)
