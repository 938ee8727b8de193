"""Counts, missing values, distributions and contingency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import profile
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import (
    LINE_NUMBERS,
    LINEITEM_WITH_GAPS,
    ORDERS_WITH_GAPS,
    lineitem_with_gaps,
    orders_with_gaps,
    table,
)

GAP_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_rare", "o_orderpriority"]


def union_over(columns, make) -> str:
    return " UNION ALL ".join(make(c) for c in columns)


@checked(
    "SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1"
)
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(table(spark, d, "events"), "event_type")


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderstatus AS value, count(*) AS count,
       round(count(*) / (SELECT CAST(count(o_orderstatus) AS DOUBLE) FROM g), 9) AS share
FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    out = profile.value_shares(orders_with_gaps(spark, d), "o_orderstatus")
    return out.withColumn("share", F.round("share", 9))


@checked("""
WITH c AS (SELECT o_orderpriority AS label, count(*) AS count FROM orders GROUP BY 1)
SELECT label, count, round(count * 100.0E0 / (SELECT sum(count) FROM c), 6) AS percent,
       round((SELECT max(count) / CAST(min(count) AS DOUBLE) FROM c), 6) AS imbalance_ratio FROM c""")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = profile.class_distribution(table(spark, d, "orders"), "o_orderpriority")
    return out.withColumns(
        {"percent": F.round("percent", 6), "imbalance_ratio": F.round("imbalance_ratio", 6)}
    )


@checked('SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem')
def table_shape(spark: SparkSession, d: str) -> DataFrame:
    return profile.table_shape(table(spark, d, "lineitem"))


@checked(
    f"WITH g AS ({ORDERS_WITH_GAPS}) "
    + union_over(
        GAP_COLUMNS,
        lambda c: f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 9) AS share FROM g",
    )
)
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profile.missing_profile(orders_with_gaps(spark, d), GAP_COLUMNS)
    return out.withColumn("share", F.round("share", 9))


_MATRIX = ["o_custkey", "o_orderstatus", "o_totalprice"]


@checked(
    f"WITH h AS ({ORDERS_WITH_GAPS}), j AS (SELECT CAST(CAST('0x' || substr(md5(md5(CAST(o_orderkey AS VARCHAR) || ':42')), "
    "31, 2) AS INTEGER) % 64 AS INTEGER) AS bucket, * FROM h) "
    + union_over(
        _MATRIX,
        lambda c: f"SELECT bucket, '{c}' AS \"column\", "
        f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 9) AS missing_share FROM j GROUP BY bucket",
    )
)
def missing_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = profile.missing_matrix(orders_with_gaps(spark, d), "o_orderkey", _MATRIX)
    return out.withColumn("missing_share", F.round("missing_share", 9))


_PART_TYPES = {
    "p_partkey": "bigint",
    "p_name": "string",
    "p_brand": "string",
    "p_type": "string",
    "p_size": "int",
    "p_retailprice": "double",
}


def column_profile_sql(source: str, types: dict[str, str]) -> str:
    return union_over(
        types,
        lambda c: f"SELECT '{c}' AS \"column\", '{types[c]}' AS type, count(*) AS \"rows\", "
        f"(count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS missing_share, count(DISTINCT {c}) AS n_distinct, "
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct_with_missing FROM {source}",
    )


@checked(column_profile_sql("part", _PART_TYPES))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(table(spark, d, "part"))


_GAP_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_rare": "double",
    "o_orderpriority": "string",
}


@checked(
    f"WITH g AS ({ORDERS_WITH_GAPS}), p AS ({column_profile_sql('g', _GAP_TYPES)}) "
    'SELECT "column", n_distinct, n_distinct_with_missing FROM p'
)
def distinct_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profile.column_profile(orders_with_gaps(spark, d), GAP_COLUMNS)
    return out.select("column", "n_distinct", "n_distinct_with_missing")


@checked("""
SELECT 'bigint' AS type, CAST(1 AS BIGINT) AS n_columns, 'p_partkey' AS columns, count(*) AS n_rows FROM part
UNION ALL SELECT 'string', 3, 'p_brand,p_name,p_type', count(*) FROM part
UNION ALL SELECT 'int', 1, 'p_size', count(*) FROM part
UNION ALL SELECT 'double', 1, 'p_retailprice', count(*) FROM part""")
def type_groups(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return profile.type_groups(part).withColumn("n_rows", part.agg(F.count("*")).scalar())


@checked("""
WITH v AS (
  SELECT 'p_size' AS "column", CAST(p_size AS VARCHAR) AS value FROM part UNION ALL
  SELECT 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part UNION ALL
  SELECT 'p_brand', p_brand FROM part UNION ALL
  SELECT 'p_type', p_type FROM part),
u AS (SELECT DISTINCT "column", value FROM v),
n AS (SELECT "column" FROM u GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)
SELECT "column", value FROM u WHERE "column" IN (SELECT "column" FROM n)""")
def low_cardinality_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.low_cardinality_values(
        table(spark, d, "part"), ["p_size", "p_partkey", "p_brand", "p_type"]
    )


@checked("""
SELECT feature_value, class, count,
       round(count / CAST(sum(count) OVER (PARTITION BY feature_value) AS DOUBLE), 9) AS share
FROM (SELECT o_orderstatus AS feature_value, o_orderpriority AS class, count(*) AS count FROM orders GROUP BY 1, 2)""")
def crosstab_share(spark: SparkSession, d: str) -> DataFrame:
    out = profile.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return out.withColumn("share", F.round("share", 9))


@checked("""
SELECT l_returnflag AS feature_value, count(*) FILTER (l_linestatus = 'F') AS "F",
       count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return profile.crosstab_wide(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


_BINNED = [*LINE_NUMBERS, "l_net"]


def _long_sql(columns, source: str, extra: str = "") -> str:
    return union_over(
        columns, lambda c: f"SELECT {extra}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {source}"
    )


@checked(f"""
WITH g AS ({LINEITEM_WITH_GAPS}), v AS ({_long_sql(_BINNED, "g")}),
b AS (SELECT "column", min(value) AS least, max(value) AS most FROM v GROUP BY 1),
p AS (SELECT v."column", CAST(least(floor((value - least) / (most - least) * 30), 29) AS INTEGER) AS bin, count(*) AS n
      FROM v JOIN b ON v."column" = b."column" WHERE value IS NOT NULL GROUP BY 1, 2),
e AS (SELECT "column", least, most, CAST(unnest(range(30)) AS INTEGER) AS bin FROM b)
SELECT e."column", e.bin, round(least + (most - least) / 30 * e.bin, 6) AS lo,
       round(least + (most - least) / 30 * (e.bin + 1), 6) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM e LEFT JOIN p ON e."column" = p."column" AND e.bin = p.bin""")
def histogram_30(spark: SparkSession, d: str) -> DataFrame:
    out = profile.histogram(lineitem_with_gaps(spark, d), _BINNED)
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@checked(
    "WITH c AS ("
    + union_over(
        ["p_name", "p_brand", "p_type"],
        lambda c: f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM part GROUP BY 2",
    )
    + ') SELECT * FROM c WHERE "column" IN (SELECT "column" FROM c GROUP BY 1 HAVING count(*) < 50)'
)
def category_bars(spark: SparkSession, d: str) -> DataFrame:
    return profile.category_bars(table(spark, d, "part"))


@checked(f"""
WITH g AS ({LINEITEM_WITH_GAPS}), v AS ({_long_sql(["l_quantity", "l_extendedprice"], "g", "l_returnflag AS class, ")}),
q AS (SELECT class, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT q."column", q.class, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
       min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
       max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM v JOIN q ON v.class = q.class AND v."column" = q."column" WHERE value IS NOT NULL
GROUP BY q."column", q.class, q1, median, q3""")
def box_stats_by_class(spark: SparkSession, d: str) -> DataFrame:
    out = profile.box_stats(lineitem_with_gaps(spark, d), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@checked("""
SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, user_id LIMIT 10""")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("count"))
    return profile.top_k(counts, "count", 10, "user_id")


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count,
       round(count(*) / (SELECT CAST(count(o_orderstatus) AS DOUBLE) FROM g), 9) AS share
FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*), round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM g), 9)
FROM g GROUP BY 2""")
def shares_of_columns(spark: SparkSession, d: str) -> DataFrame:
    out = profile.grouped_shares(orders_with_gaps(spark, d), ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("share", F.round("share", 9))


@checked("""
WITH v AS (SELECT CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type
                  WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE CAST(user_id AS VARCHAR) || '.5' END AS mixed FROM events)
SELECT 'mixed' AS "column",
       CASE WHEN regexp_matches(mixed, '^[+-]?[0-9]+$') THEN 'int'
            WHEN regexp_matches(mixed, '^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN 'double'
            WHEN regexp_matches(mixed, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' ELSE 'text' END AS shape,
       count(*) AS count FROM v GROUP BY 2""")
def mixed_types(spark: SparkSession, d: str) -> DataFrame:
    from tabloom.operators.roles import mixed_types as find

    k = F.col("event_id") % 4
    user = F.col("user_id").cast("string")
    events = table(spark, d, "events").select(
        "event_type",
        F.when(k == 0, user)
        .when(k == 1, F.col("event_type"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(user, F.lit(".5")))
        .alias("mixed"),
    )
    return find(events, ["event_type", "mixed"])


@checked("""
SELECT 'signed' AS "column", CAST(3 AS BIGINT) AS n_distinct, CAST(4 AS BIGINT) AS n_distinct_with_missing
FROM orders HAVING count(*) > 3""")
def distinct_signed_zero(spark: SparkSession, d: str) -> DataFrame:
    """0.0 and -0.0 are one value."""
    key = F.col("o_orderkey") % 5
    signed = F.when(key == 0, F.lit(0.0)).when(key == 1, F.lit(-0.0)).when(key == 2, F.lit(1.0)).when(key == 3, F.lit(2.5))
    out = profile.column_profile(table(spark, d, "orders").select(signed.alias("signed")))
    return out.select("column", "n_distinct", "n_distinct_with_missing")
