"""Column roles: which columns are identifiers, categories, counts or measures.

Every rule is a decision over one statistics row per column, so a table of any
length is read once and at most one row per column reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.aggregate import long_form, numeric_columns, text_columns
from tabloom.operators.profile import column_profile, few_valued, missing_profile

_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_FLOATS = ("float", "double")
#: Counters that have many values but identify nothing (a fixed value).
NEVER_IDS = ("at_bat_number",)


@dataclass(frozen=True)
class FeatureGroups:
    """Named column lists: the working schema of a run."""

    target: str
    categorical: tuple[str, ...] = ()
    identifying: tuple[str, ...] = ()
    id_flags: tuple[str, ...] = ()
    discrete: tuple[str, ...] = ()
    continuous: tuple[str, ...] = ()
    hashed: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    excluded: tuple[str, ...] = field(default=())

    @property
    def included(self) -> list[str]:
        return [
            *self.categorical,
            *self.identifying,
            *self.id_flags,
            *self.discrete,
            *self.continuous,
            *self.hashed,
            *self.binary,
        ]

    def overlap(self) -> list[str]:
        """Names that are both included and excluded."""
        return sorted(set(self.included) & set(self.excluded))

    def missing_from(self, columns: Sequence[str]) -> list[str]:
        return [c for c in self.included if c not in set(columns)]


def _is_type(*names: str) -> Column:
    return F.col("type").isin(list(names))


def _is_number() -> Column:
    return _is_type(*_INTEGERS, *_FLOATS, "boolean") | F.col("type").startswith("decimal")


def _is_text() -> Column:
    return _is_type("string", "date", "timestamp")


def column_roles(
    df: DataFrame,
    missing_threshold: float = 0.2,
    discrete_distinct: int = 15,
    exclude_substrings: Sequence[str] = (),
    counts: bool = True,
) -> DataFrame:
    """Four-way roles: excluded (by name or by missing share), object, discrete, continuous.

    Without ``counts`` the roles are the same, but there is no ``n_distinct``:
    only numbers that are not excluded, and that a sketch does not show to be over
    the limit, are counted.
    """
    by_name = F.lit(False)
    for part in exclude_substrings:
        by_name = by_name | F.col("column").contains(part)
    role = (
        F.when(by_name, "excluded_by_name")
        .when(F.col("missing_share") > missing_threshold, "excluded_missing")
        .when(_is_text(), "object")
        .when(_is_number() & (F.col("n_distinct") <= discrete_distinct), "discrete")
        .when(_is_number(), "continuous")
        .otherwise("other")
    )
    if counts:
        return column_profile(df).select("column", "type", role.alias("role"), "missing_share", "n_distinct")
    found = missing_profile(df).filter(F.col("share").isNotNull()).collect()  # a row per column; none of an empty table
    types = dict(df.dtypes)
    open_numbers = {
        r["column"] for r in found if r["share"] <= missing_threshold and not any(part in r["column"] for part in exclude_substrings)
    } & set(numeric_columns(df))
    few = few_valued(df, [c for c in df.columns if c in open_numbers], discrete_distinct) if open_numbers else []
    counted = {r["column"]: r["n_distinct"] for r in column_profile(df, few).select("column", "n_distinct").collect()} if few else {}
    # a column that was not counted is over the limit, or its role does not depend on it
    rows = [(r["column"], types[r["column"]], r["share"], counted.get(r["column"], discrete_distinct + 1)) for r in found]
    table = df.sparkSession.createDataFrame(rows, "column string, type string, missing_share double, n_distinct bigint")
    return table.select("column", "type", role.alias("role"), "missing_share")


def roles_by_type(df: DataFrame, ordinal: Sequence[str] = ()) -> DataFrame:
    """Integer -> discrete, float -> continuous, text -> ordinal if listed, else nominal.

    ``maybe_ordinal`` marks integer columns with 2 to 100 distinct values.
    """
    role = (
        F.when(_is_type(*_INTEGERS), "discrete")
        .when(_is_type(*_FLOATS), "continuous")
        .when(_is_text() & F.col("column").isin(list(ordinal)), "ordinal")
        .when(_is_text(), "nominal")
        .otherwise("other")
    )
    maybe = _is_type(*_INTEGERS) & F.col("n_distinct").between(2, 100)
    return column_profile(df).select(
        "column", "type", role.alias("role"), maybe.cast("int").alias("maybe_ordinal"), "n_distinct"
    )


def split_roles(
    df: DataFrame, target: str | None = None, ids: Sequence[str] = (), cardinality: int = 30
) -> DataFrame:
    """Numbers -> numerical; text with few values (missing counts as one) -> categorical; rest dropped."""
    skip = {target, *ids}
    columns = [c for c in df.columns if c not in skip]
    # numbers need no count, and text that surely has more values is not counted either
    few = few_valued(df, [c for c in columns if c in set(text_columns(df))], cardinality)
    counts = column_profile(df, few).select("column", "n_distinct_with_missing").collect() if few else []
    kept = {r["column"] for r in counts if r["n_distinct_with_missing"] <= cardinality}
    types = dict(df.dtypes)
    table = df.sparkSession.createDataFrame([(c, types[c], c in kept) for c in columns], "column string, type string, few boolean")
    role = F.when(_is_number(), "numerical").when(_is_text() & F.col("few"), "categorical").otherwise("dropped")
    return table.select("column", "type", role.alias("role"))


def cardinality_split(df: DataFrame, threshold: int = 50) -> DataFrame:
    """Text columns split at a distinct count: ``kept`` below it, ``skipped`` from it on."""
    kept = F.col("n_distinct") < threshold
    return column_profile(df, text_columns(df)).select(
        "column", "n_distinct", F.when(kept, "kept").otherwise("skipped").alias("role")
    )


def id_like_columns(df: DataFrame, distinct: int = 50, never: Sequence[str] = NEVER_IDS) -> DataFrame:
    """Text or long columns with more distinct values than the limit, with distinct/rows."""
    candidates = (_is_text() | _is_type("bigint")) & ~F.col("column").isin(list(never))
    return (
        column_profile(df)
        .filter(candidates & (F.col("n_distinct") > distinct))
        .select("column", "type", "n_distinct", (F.col("n_distinct") / F.col("rows")).alias("distinct_ratio"))
    )


# Shape of one raw text value, tested in this order.
_SHAPES = (
    ("int", r"^[+-]?[0-9]+$"),
    ("double", r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
)


def value_shape(value: Column) -> Column:
    """``int``, ``double``, ``date`` or ``text`` by the look of a raw value."""
    (first, pattern), *rest = _SHAPES
    out = F.when(value.rlike(pattern), first)
    for name, pattern in rest:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise("text")


def mixed_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, shape, count) of the columns whose values have more than one shape."""
    shapes = (
        long_form(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", value_shape(F.col("value")).alias("shape"))
        .agg(F.count("*").alias("count"))
    )
    mixed = shapes.groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    # at most one row per column name of the table
    return shapes.join(F.broadcast(mixed), "column", "left_semi")


def names_where(table: DataFrame, condition: Column | None = None) -> list[str]:
    """Column names of a per-column table, in name order."""
    picked = table if condition is None else table.filter(condition)
    return sorted(r["column"] for r in picked.select("column").collect())


def drop_strict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; a name that is not there is an error."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*columns)


def select_types(df: DataFrame, kind: str) -> DataFrame:
    """Project the columns of one kind: number, text, int or float."""
    if kind == "number":
        return df.select(*numeric_columns(df))
    if kind == "text":
        return df.select(*text_columns(df))
    wanted = {"int": _INTEGERS, "float": _FLOATS}[kind]
    return df.select(*[c for c, t in df.dtypes if t in wanted])


def drop_containing(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Drop columns whose name contains any of the parts."""
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def drop_sparse(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Drop columns whose missing share is above the threshold."""
    return df.drop(*names_where(missing_profile(df), F.col("share") > threshold))


def drop_ids(df: DataFrame, distinct: int = 50) -> DataFrame:
    """Drop identifier-like columns (see ``id_like_columns``); the frame comes back unchanged if there are none.

    Columns are counted exactly only where a sketch does not show that they are over the limit.
    """
    asked = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "date", "timestamp", "bigint") and f.name not in NEVER_IDS]
    few = few_valued(df, asked, distinct)
    counts = column_profile(df, few).select("column", "n_distinct").collect() if few else []
    kept = {r["column"] for r in counts if r["n_distinct"] <= distinct} | set(few) - {r["column"] for r in counts}
    return df.drop(*[c for c in asked if c not in kept])


def without(columns: Sequence[str], target: str, removed: Sequence[str] = ()) -> list[str]:
    """All columns but the target and a removal list."""
    return [c for c in columns if c != target and c not in set(removed)]
