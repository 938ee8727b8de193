"""Counts, missing values, cardinality, distributions and contingency tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import hash_text, md5_bucket
from tabloom.operators.aggregate import long_form, numeric_columns, one_zero, text_columns, wide_stats
from tabloom.operators.learned import sql_name
from tabloom.operators.quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), missing left out, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Value counts with each value's share of the non-missing rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    # the total comes from the grouped counts, so the rows are read once
    total = counts.groupBy(F.lit(0).alias("__all")).agg(F.sum("count").alias("__total"))
    joined = counts.withColumn("__all", F.lit(0)).join(F.broadcast(total), "__all")  # one row
    return joined.select("value", "count", F.try_divide("count", "__total").alias("share")).orderBy(F.desc("count"), "value")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, count, percent, imbalance_ratio); the ratio is majority over minority."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    return counts.select(
        "label",
        "count",
        (F.col("count") * 100.0 / counts.agg(F.sum("count")).scalar()).alias("percent"),
        (counts.agg(F.max("count") / F.min("count")).scalar()).alias("imbalance_ratio"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, share), most missing first."""
    return wide_stats(
        df,
        list(columns or df.columns),
        {
            "missing": lambda c: F.count_if(F.col(c).isNull()),
            "share": lambda c: F.avg(F.col(c).isNull().cast("double")),
        },
    ).orderBy(F.desc("missing"), "column")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, type, rows, missing_share, n_distinct, n_distinct_with_missing).

    One long pass; ``count_distinct`` per column shuffles on (column, value), so
    no column is held in one task.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    counted = (
        long_form(df, columns)
        .groupBy("column", "value")
        .agg(F.count("*").alias("k"))
        .groupBy("column")
        .agg(
            F.sum("k").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("missing"),
            F.count("value").alias("n_distinct"),
            F.count("*").alias("n_distinct_with_missing"),
        )
    )
    names = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return counted.select(
        "column",
        names[F.col("column")].alias("type"),
        "rows",
        (F.col("missing") / F.col("rows")).alias("missing_share"),
        "n_distinct",
        "n_distinct_with_missing",
    )


def few_valued(df: DataFrame, columns: Sequence[str], most: int) -> list[str]:
    """The columns that may hold up to ``most`` distinct values; every other one surely holds more.

    One pass of mergeable sketches of fixed size, without a shuffle of cells. A
    sketch of m registers reads m ln(m / empty ones) while few are in use, and n
    values use n at most; so a column that reads more than n = ``most`` values
    could is out for certain, whatever the hash. What is left is counted exactly
    by the caller. Limits too large for a small sketch, and nested columns, are
    left in.
    """
    registers = 512
    while registers < 4 * (most + 2):
        registers *= 2
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = [c for c in columns if not isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType))]
    if registers > 1 << 14 or not plain:
        return list(columns)
    precision = 1.1061 / math.sqrt(registers)
    largest = registers * math.log(registers / (registers - most - 2)) + 1
    read = df.agg(*[F.approx_count_distinct(one_zero(F.col(sql_name(c)), kinds[c]), precision).alias(str(i)) for i, c in enumerate(plain)]).first()
    over = {c for i, c in enumerate(plain) if read[str(i)] > largest}
    return [c for c in columns if c not in over]


def type_groups(df: DataFrame) -> DataFrame:
    """(type, n_columns, columns): the columns of each type, names sorted."""
    found: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        found.setdefault(kind, []).append(name)
    rows = [(kind, len(names), ",".join(sorted(names))) for kind, names in found.items()]
    return df.sparkSession.createDataFrame(rows, "type string, n_columns bigint, columns string")


def low_cardinality_values(df: DataFrame, columns: Sequence[str], least: int = 2, most: int = 100) -> DataFrame:
    """(column, value) of columns whose distinct count lies in the range, sorted.

    Columns that surely hold more are told by a sketch; of the others, values
    leave the distinct table only for the columns that qualify.
    """
    columns = few_valued(df, columns, most)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string")
    distinct = long_form(df, columns).filter(F.col("value").isNotNull()).distinct()
    sizes = distinct.groupBy("column").agg(F.count("*").alias("n"))
    fit = sizes.filter(F.col("n").between(least, most))
    # at most one row per column name of the table
    return distinct.join(F.broadcast(fit), "column", "left_semi").orderBy("column", "value")


def crosstab(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Long contingency table (feature_value, class, count, share of the row)."""
    pairs = (
        df.filter(F.col(feature).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(feature).cast("string").alias("feature_value"), F.col(label).cast("string").alias("class"))
        .agg(F.count("*").alias("count"))
    )
    rows = pairs.groupBy("feature_value").agg(F.sum("count").alias("total"))
    return pairs.join(rows, "feature_value").select(
        "feature_value", "class", "count", (F.col("count") / F.col("total")).alias("share")
    )


def crosstab_wide(df: DataFrame, feature: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Contingency table with one count column per class."""
    return (
        df.filter(F.col(feature).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(feature).alias("feature_value"))
        .pivot(label, list(classes))
        .count()
        .na.fill(0, list(classes))
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """(column, bin, lo, hi, count) over equal-width bins, empty ones included; the last bin is closed.

    A column of one value gets bins over half a unit to either side of it; a
    column without values has none. The bounds are one small aggregate; the
    counting pass combines per task, so what moves is bins x columns rows per task.
    """
    columns = list(columns or numeric_columns(df))
    bounds = wide_stats(
        df,
        columns,
        {
            "least": lambda c: F.min(F.col(c).cast("double")),
            "most": lambda c: F.max(F.col(c).cast("double")),
        },
    )
    margin = F.when(F.col("most") == F.col("least"), F.lit(0.5)).otherwise(F.lit(0.0))
    bounds = bounds.filter("least is not null").select(
        "column", (F.col("least") - margin).alias("least"), (F.col("most") + margin).alias("most")
    )
    # one row per column name of the table
    placed = long_form(df, columns, as_type="double").join(F.broadcast(bounds), "column")
    at = F.floor((F.col("value") - F.col("least")) / (F.col("most") - F.col("least")) * bins)
    counted = (
        placed.filter(F.col("value").isNotNull())
        .withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("most") - F.col("least")) / bins
    return every.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("least") + step * F.col("bin")).alias("lo"),
        (F.col("least") + step * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def category_bars(df: DataFrame, threshold: int = 50) -> DataFrame:
    """(column, value, count) of every text column with fewer distinct values than the threshold."""
    counts = (
        long_form(df, text_columns(df))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )
    low = counts.groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") < threshold)
    # at most one row per column name of the table
    return counts.join(F.broadcast(low), "column", "left_semi")


def box_stats(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outlier count of each column per class."""
    data = df.select(F.col(label).cast("string").alias("class"), *columns)
    q = exact_quantiles(data, columns, [0.25, 0.5, 0.75], ["class"])
    quartiles = q.groupBy("class", "column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    values = long_form(data, columns, ["class"], "double").filter(F.col("value").isNotNull())
    # quartiles come from a stored table, so Spark broadcasts them only if that is small
    fenced = values.join(quartiles, ["class", "column"])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy("column", "class", "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )


def missing_matrix(df: DataFrame, key: str, columns: Sequence[str], buckets: int = 64, seed: int = 42) -> DataFrame:
    """(bucket, column, missing_share): missing-value heat map over hashed row buckets."""
    marked = df.withColumn("bucket", md5_bucket(hash_text(key, seed), buckets))
    return wide_stats(
        marked,
        list(columns),
        {"missing_share": lambda c: F.avg(F.col(c).isNull().cast("double"))},
        ["bucket"],
    )


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k rows of largest score; ties in name order."""
    return df.orderBy(F.desc(score), tie).limit(k)


def grouped_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count, share) for several columns in one pass."""
    counts = (
        long_form(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "count", (F.col("count") / F.col("total")).alias("share")
    )
