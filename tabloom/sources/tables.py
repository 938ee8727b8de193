"""Readers with a declared or inferred schema, writers and date ranges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.aggregate import wide_stats
from tabloom.operators.learned import sql_name

# Text that a CSV reader of the pandas family treats as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, quoted_breaks: bool = False
) -> DataFrame:
    """Header CSV read as text, missing-value tokens to null, then cast by the schema.

    Casting after reading keeps an all-empty column at its declared type and
    turns junk into null instead of failing the job. Without a schema the types
    come from ``infer_schema``, one pass more. ``quoted_breaks`` reads line
    breaks within quotes; a file is then one task, so it is off by default.
    """
    raw = _raw_csv(spark, path, quoted_breaks)
    if schema is None:
        schema = infer_types(raw)
    absent = [f.name for f in schema.fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"columns not in the file: {absent}")
    return raw.select(*[_typed(F.col(sql_name(f.name)), f.dataType).alias(f.name) for f in schema.fields])


def _raw_csv(spark: SparkSession, path: str, quoted_breaks: bool) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", quoted_breaks).csv(path)


def infer_schema(spark: SparkSession, path: str, quoted_breaks: bool = False) -> T.StructType:
    """The type of every column of a header CSV, decided over all its rows."""
    return infer_types(_raw_csv(spark, path, quoted_breaks))


#: Types a text column may turn out to hold, narrowest first.
_LATTICE = (
    ("whole", T.LongType()),
    ("number", T.DoubleType()),
    ("truth", T.BooleanType()),
    ("day", T.DateType()),
)
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?(inf|infinity)\s*$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def infer_types(raw: DataFrame) -> T.StructType:
    """Narrowest type that every known value of a text column fits.

    A column is a long, else a double, a boolean, a date (ISO), else text. One
    pass counts, per column, the known values and those that fit each type; the
    counts of two tasks add up, so no sample decides and no row order matters.
    Missing-value tokens fit any type: a long column keeps them as nulls, a
    column without known values is a double. Whole numbers beyond 64 bits are
    doubles, numbers among texts leave the column text.
    """
    numbered = raw.toDF(*[str(i) for i in range(len(raw.columns))])
    known = lambda c: ~F.col(c).isin(list(MISSING_TEXT))  # noqa: E731  null for null: not counted
    number = lambda c: F.col(c).rlike(_NUMBER) | F.lower(F.col(c)).rlike(_INFINITE)
    fits = {
        "known": known,
        "whole": lambda c: known(c) & F.col(c).rlike(_WHOLE) & F.col(c).try_cast("bigint").isNotNull(),
        "number": lambda c: known(c) & number(c),
        "truth": lambda c: known(c) & F.col(c).isin("True", "TRUE", "true", "False", "FALSE", "false"),
        "day": lambda c: known(c) & F.col(c).rlike(_DAY) & F.col(c).try_cast("date").isNotNull(),
    }
    counted = wide_stats(numbered, numbered.columns, {n: lambda c, fit=fit: F.count_if(fit(c)) for n, fit in fits.items()})
    rows = {int(r["column"]): r for r in counted.collect()}  # a row per column of the table
    fields = []
    for i, name in enumerate(raw.columns):
        kind = next((kind for n, kind in _LATTICE if rows[i][n] == rows[i]["known"]), T.StringType())
        fields.append(T.StructField(name, T.DoubleType() if not rows[i]["known"] else kind))
    return T.StructType(fields)


def _typed(c: Column, kind: T.DataType) -> Column:
    known = F.when(c.isin(list(MISSING_TEXT)), F.lit(None)).otherwise(c)
    if isinstance(kind, T.StringType):
        return known
    if isinstance(kind, (T.LongType, T.IntegerType)):
        # "660271.0" and "660271" are the same id
        whole = F.regexp_replace(known, r"[.]0*$", "")
        return whole.try_cast(kind)
    return known.try_cast(kind)


def date_range(df: DataFrame, column: str, first: date | str, last: date | str) -> DataFrame:
    """Rows whose date lies in [first, last].

    The bounds are compared with the bare column, so the filter reaches the
    Parquet footer, or prunes folders when the table is partitioned by it.
    """
    lo = F.to_date(F.lit(str(first)))
    hi = F.date_add(F.to_date(F.lit(str(last))), 1)
    return df.filter((F.col(column) >= lo) & (F.col(column) < hi))


def write_csv(df: DataFrame, path: str) -> bool:
    """Write header CSV unless the frame is empty; tells whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def land_by_date(df: DataFrame, path: str, column: str) -> None:
    """Parquet partitioned by date.

    The rebalance hint gathers a date's rows into few files and lets adaptive
    execution split a date that holds too much for one task.
    """
    out = df.withColumn(column, F.to_date(column)).hint("rebalance", column)
    out.write.mode("overwrite").partitionBy(column).parquet(path)
