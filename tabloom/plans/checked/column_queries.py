"""Column roles, projections, predicates, ingest and keyed lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import roles
from tabloom.operators.lookup import lookup
from tabloom.operators.profile import value_counts
from tabloom.plans import pitches
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import (
    LINEITEM_WITH_GAPS,
    ORDERS_WITH_GAPS,
    lineitem_with_gaps,
    orders_with_gaps,
    table,
)
from tabloom.plans.checked.profile_queries import (
    _GAP_TYPES,
    _PART_TYPES,
    GAP_COLUMNS,
    column_profile_sql,
    union_over,
)
from tabloom.session import ensure_checkpoint_dir
from tabloom.sources.tables import date_range, land_by_date, read_csv, write_csv


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS}), p AS ({column_profile_sql("g", _GAP_TYPES)})
SELECT "column", type, CASE WHEN "column" LIKE '%priority%' THEN 'excluded_by_name'
         WHEN missing_share > 0.2 THEN 'excluded_missing' WHEN type = 'string' THEN 'object'
         WHEN n_distinct <= 15 THEN 'discrete' ELSE 'continuous' END AS role,
       round(missing_share, 9) AS missing_share, n_distinct FROM p""")
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    df = orders_with_gaps(spark, d).select(*GAP_COLUMNS)
    out = roles.column_roles(df, exclude_substrings=["priority"])
    return out.withColumn("missing_share", F.round("missing_share", 9))


@checked(f"""
WITH p AS ({column_profile_sql("part", _PART_TYPES)})
SELECT "column", type, CASE WHEN type IN ('int', 'bigint') THEN 'discrete' WHEN type = 'double' THEN 'continuous'
         WHEN "column" = 'p_type' THEN 'ordinal' ELSE 'nominal' END AS role,
       CASE WHEN type IN ('int', 'bigint') AND n_distinct BETWEEN 2 AND 100 THEN 1 ELSE 0 END AS maybe_ordinal,
       n_distinct FROM p""")
def roles_by_type(spark: SparkSession, d: str) -> DataFrame:
    return roles.roles_by_type(table(spark, d, "part"), ordinal=["p_type"])


@checked(f"""
WITH p AS ({column_profile_sql("part", _PART_TYPES)})
SELECT "column", type, CASE WHEN type <> 'string' THEN 'numerical'
         WHEN n_distinct_with_missing <= 30 THEN 'categorical' ELSE 'dropped' END AS role
FROM p WHERE "column" NOT IN ('p_type', 'p_partkey')""")
def split_roles(spark: SparkSession, d: str) -> DataFrame:
    return roles.split_roles(table(spark, d, "part"), target="p_type", ids=["p_partkey"])


@checked(f"""
WITH p AS ({column_profile_sql("part", _PART_TYPES)})
SELECT "column", n_distinct, CASE WHEN n_distinct < 50 THEN 'kept' ELSE 'skipped' END AS role
FROM p WHERE type = 'string'""")
def cardinality_split(spark: SparkSession, d: str) -> DataFrame:
    return roles.cardinality_split(table(spark, d, "part"))


@checked(f"""
WITH p AS ({column_profile_sql("part", _PART_TYPES)})
SELECT "column", type, n_distinct, round(n_distinct / CAST("rows" AS DOUBLE), 9) AS distinct_ratio
FROM p WHERE type IN ('string', 'bigint') AND n_distinct > 50""")
def id_like_columns(spark: SparkSession, d: str) -> DataFrame:
    out = roles.id_like_columns(table(spark, d, "part"))
    return out.withColumn("distinct_ratio", F.round("distinct_ratio", 9))


@checked("SELECT p_brand, p_type, p_size, p_retailprice FROM part")
def drop_id_columns(spark: SparkSession, d: str) -> DataFrame:
    return roles.drop_ids(table(spark, d, "part"))


@checked(f"WITH g AS ({ORDERS_WITH_GAPS}) SELECT o_orderkey, o_orderstatus, o_orderpriority FROM g")
def drop_sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    return roles.drop_sparse(orders_with_gaps(spark, d).drop("o_orderdate"), 0.1)


@checked("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def explicit_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")


@checked("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def drop_named(spark: SparkSession, d: str) -> DataFrame:
    df = roles.drop_strict(table(spark, d, "orders"), ["o_custkey", "o_totalprice"])
    return df.drop("o_orderdate", "no_such_column")


@checked("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_numeric(spark: SparkSession, d: str) -> DataFrame:
    return roles.select_types(table(spark, d, "part"), "number")


@checked("SELECT c_custkey, c_acctbal FROM customer")
def drop_by_substring(spark: SparkSession, d: str) -> DataFrame:
    return roles.drop_containing(table(spark, d, "customer"), ["name", "nation", "segment"])


@checked("""
SELECT l_orderkey, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'in play' ELSE l_linestatus END AS recoded
FROM lineitem WHERE l_linestatus = 'F'""")
def masked_assignment(spark: SparkSession, d: str) -> DataFrame:
    from tabloom.functions.expressions import recode_where

    df = table(spark, d, "lineitem").filter(F.col("l_linestatus") == "F")
    new = recode_where(F.col("l_returnflag") == "R", F.lit("in play"), F.col("l_linestatus"))
    return df.select("l_orderkey", "l_returnflag", new.alias("recoded"))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@checked(
    "WITH n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM orders) "
    + union_over(
        _ORDER_COLUMNS[:-1],
        lambda c: f"SELECT '{c}' AS feature, {int(c not in ('o_totalprice', 'o_orderdate'))} AS cleaned, n AS rows_seen FROM n",
    )
)
def feature_lists(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    original = roles.without(orders.columns, "o_orderpriority")
    cleaned = roles.without(orders.columns, "o_orderpriority", ["o_totalprice", "o_orderdate"])
    marked = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(int(c in cleaned)).alias("cleaned")) for c in original])
    rows = orders.agg(F.count("*").alias("rows_seen"))
    return rows.select(F.inline(marked), "rows_seen")


@checked("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders
WHERE o_orderdate >= DATE '1997-03-28' AND o_orderdate < DATE '1997-10-01'""")
def date_range_ingest(spark: SparkSession, d: str) -> DataFrame:
    got = date_range(table(spark, d, "orders"), "o_orderdate", "1997-03-28", "1997-09-30")
    return got.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM g""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Header CSV written only if there are rows, read back with a declared schema."""
    df = orders_with_gaps(spark, d).select(*_ORDER_COLUMNS).withColumn("o_orderdate", F.to_date("o_orderdate"))
    path = _scratch(spark)
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


@checked("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-05-01' GROUP BY 1""")
def landed_date_range(spark: SparkSession, d: str) -> DataFrame:
    """Parquet landed by month, then read for a range of months with folder pruning."""
    path = _scratch(spark)
    land_by_date(table(spark, d, "orders").withColumn("month", F.trunc("o_orderdate", "month")), path, "month")
    got = date_range(spark.read.parquet(path), "month", "1998-01-01", "1998-04-01")
    return got.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS}), c AS (SELECT o_custkey, count(*) AS stat FROM g WHERE o_custkey IS NOT NULL GROUP BY 1)
SELECT g.o_orderkey, coalesce(c.stat, 0) AS stat FROM g LEFT JOIN c ON g.o_custkey = c.o_custkey""")
def lookup_default_zero(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    counts = value_counts(g, "o_custkey").select(F.col("value").alias("o_custkey"), F.col("count").alias("stat"))
    return lookup(g, counts, ["o_custkey"]).select("o_orderkey", F.coalesce("stat", F.lit(0)).alias("stat"))


@checked("""
SELECT d.doc_id, d.lang, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def align_by_key(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@checked(f"""
WITH g AS ({LINEITEM_WITH_GAPS})
SELECT "column", count(*) AS n FROM (
  SELECT 'l_quantity' AS "column" FROM g WHERE l_quantity IS NULL UNION ALL
  SELECT 'l_extendedprice' FROM g WHERE l_extendedprice IS NULL UNION ALL
  SELECT 'l_tax' FROM g WHERE l_tax IS NULL) GROUP BY 1""")
def missing_columns_sorted(spark: SparkSession, d: str) -> DataFrame:
    from tabloom.operators.profile import missing_profile

    out = missing_profile(lineitem_with_gaps(spark, d)).filter(F.col("missing") > 0)
    return out.select("column", F.col("missing").alias("n"))


# ---------------------------------------------------------------- the shipped 113-column configuration


def _pitch_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders under the shipped schema: text, whole numbers and measures by declared type, every deprecated column half empty."""
    key = F.col("o_orderkey")
    by_kind = {
        "string": F.col("o_orderstatus"),
        "bigint": F.col("o_custkey"),
        "int": (key % 40).cast("int"),
        "double": F.col("o_totalprice"),
        "date": F.to_date("o_orderdate"),
    }
    columns = []
    for f in pitches.schema().fields:
        value = by_kind[f.dataType.simpleString()]
        columns.append((F.when(key % 2 == 0, value) if f.name in pitches.DEPRECATED else value).alias(f.name))
    return table(spark, d, "orders").select(*columns)


def _names_sql(groups: dict) -> str:
    rows = ", ".join(f"('{g}', '{c}')" for g, names in groups.items() for c in names)
    return f'SELECT g AS "group", c AS "column", (SELECT count(*) FROM orders) AS n FROM (VALUES {rows}) v(g, c)'


def _counted_lists() -> dict:
    """What the rules must give: text in the names, half-empty columns and five fixed names are left out."""
    by_name = [c for c in pitches.columns() if any(x in c for x in pitches.BY_NAME)]
    gone = [*by_name, *pitches.DEPRECATED, "game_year", "game_type", "des", "player_name", "type"]
    return {
        "categorical": pitches.CATEGORICAL,
        "identifying": ("game_date", *pitches.FIELDERS, "batter", "pitcher", "game_pk"),
        "id_flags": pitches.BASES,
        "excluded": [c for c in dict.fromkeys(gone) if c not in pitches.BASES],
    }


@checked(_names_sql(_counted_lists()))
def assembled_groups(spark: SparkSession, d: str) -> DataFrame:
    """Named column lists read off a table by name, missing share and fixed names."""
    df = _pitch_table(spark, d)
    groups = pitches.counted_groups(df)
    rows = [(g, c) for g in ("categorical", "identifying", "id_flags", "excluded") for c in getattr(groups, g)]
    named = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(c).alias("column")) for g, c in rows])
    return df.agg(F.count("*").alias("n")).select(F.inline(named), "n")


@checked("""
SELECT o_orderkey % 40 AS balls, o_orderstatus AS stand, count(*) AS n, CAST(67 AS INTEGER) AS columns_left
FROM orders GROUP BY 1, 2""")
def shipped_drop_lists(spark: SparkSession, d: str) -> DataFrame:
    """Leaking, deprecated, redundant and game columns dropped by the shipped lists: 66 features and the target stay."""
    gone = [*pitches.GAME, *pitches.LEAKY, *pitches.DEPRECATED, *pitches.REDUNDANT]
    left = roles.drop_strict(_pitch_table(spark, d), gone)
    out = left.groupBy(F.col("balls").cast("bigint").alias("balls"), "stand").agg(F.count("*").alias("n"))
    return out.withColumn("columns_left", F.lit(len(left.columns)))


# name -> text as it stands in the file, and the SQL of the value it must be read as
_MIXED = {
    "whole": ("CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS STRING) ELSE 'NA' END", "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END"),
    "number": ("IF(o_orderkey % 2 = 0, '1', IF(o_orderkey % 5 = 0, '-2.5e1', '.5'))", "CASE WHEN o_orderkey % 2 = 0 THEN 1.0E0 WHEN o_orderkey % 5 = 0 THEN -25.0E0 ELSE 0.5E0 END"),
    "flag": ("CASE o_orderkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END", "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"),
    "day": ("IF(o_orderkey % 7 = 0, 'NaN', CAST(CAST(o_orderdate AS DATE) AS STRING))", "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END"),
    "day_or_text": ("IF(o_orderkey % 7 = 0, 'never', CAST(CAST(o_orderdate AS DATE) AS STRING))", "CASE WHEN o_orderkey % 7 = 0 THEN 'never' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END"),
    "number_or_text": ("IF(o_orderkey % 100 = 7, 'x', CAST(o_orderkey AS STRING))", "CASE WHEN o_orderkey % 100 = 7 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END"),
    "vast": ("IF(o_orderkey % 4 = 1, '18446744073709551616', '1')", "CASE WHEN o_orderkey % 4 = 1 THEN 18446744073709551616.0E0 ELSE 1.0E0 END"),
    "nothing": ("IF(o_orderkey % 2 = 0, 'null', 'N/A')", "CAST(NULL AS DOUBLE)"),
}


@checked("SELECT o_orderkey, " + ", ".join(f"{want} AS {n}" for n, (_, want) in _MIXED.items()) + " FROM orders")
def csv_inferred_types(spark: SparkSession, d: str) -> DataFrame:
    """Columns of mixed texts written as CSV and read back without a schema."""
    texts = table(spark, d, "orders").select("o_orderkey", *[F.expr(text).alias(n) for n, (text, _) in _MIXED.items()])
    path = _scratch(spark)
    write_csv(texts, path)
    return read_csv(spark, path)


@checked("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def second_schema_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same reader over another table with a schema of its own."""
    customer = table(spark, d, "customer")
    few = customer.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    path = _scratch(spark)
    write_csv(few, path)
    return read_csv(spark, path, few.schema)


@checked("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def first_row(spark: SparkSession, d: str) -> DataFrame:
    """One example row, by an explicit order."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@checked("""
SELECT o_orderkey, coalesce(o_orderstatus, 'none') || '/' || substr(o_orderpriority, 1, 1) AS status
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)""")
def function_as_stage(spark: SparkSession, d: str) -> DataFrame:
    """A plain function of a frame used as a step."""

    def tagged(df: DataFrame, other: str) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        return df.withColumn("status", F.concat_ws("/", F.coalesce("o_orderstatus", F.lit(other)), first))

    return orders_with_gaps(spark, d).transform(tagged, "none").select("o_orderkey", "status")
