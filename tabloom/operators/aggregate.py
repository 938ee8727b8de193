"""Wide one-pass aggregates returned in long form, and their long counterpart."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# More aggregates than this in one stage fall out of generated code.
COLUMNS_PER_PASS = 32


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    """String columns, and dates, which arrive as text."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType))
    ]


def wide_stats(
    df: DataFrame,
    columns: Sequence[str],
    stats: Mapping[str, Callable[[str], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per (by, column) with the given statistics.

    Rows of data are not multiplied: the statistics are computed side by side
    and only the aggregated rows are turned into long form. Columns go in
    chunks, each reading only its own columns.
    """
    parts = []
    for at in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[at : at + COLUMNS_PER_PASS]
        exprs = [fn(c).alias(f"{i}_{s}") for i, c in enumerate(chunk) for s, fn in stats.items()]
        one = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
        rows = F.array(
            *[
                F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{s}").alias(s) for s in stats])
                for i, c in enumerate(chunk)
            ]
        )
        parts.append(one.select(*by, F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def one_zero(c: Column, kind: T.DataType) -> Column:
    """The column with -0.0 as 0.0, so that both are one value."""
    if isinstance(kind, T.DoubleType):
        return c + F.lit(0.0)
    if isinstance(kind, T.FloatType):
        return c + F.lit(0.0).cast("float")
    return c


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), as_type: str = "string") -> DataFrame:
    """Rows of (keep..., column, value); missing values are kept, -0.0 is 0.0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cast = df.select(*keep, *[one_zero(F.col(c), kinds[c]).cast(as_type).alias(c) for c in columns])
    return cast.unpivot(list(keep), list(columns), "column", "value")
