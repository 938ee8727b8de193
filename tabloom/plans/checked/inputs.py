"""Input frames of the checked queries and the same inputs as SQL.

The driver tables hold no nulls, so gaps are derived from the key by the same
rule on both sides; every row stays in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 20 == 0, F.round(F.col("o_totalprice") / 1000)).alias("o_rare"),
        "o_orderdate",
        "o_orderpriority",
    )


ORDERS_WITH_GAPS = """
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 20 = 0 THEN round(o_totalprice / 1000) END AS o_rare,
         o_orderdate, o_orderpriority
  FROM orders"""


LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        F.when(key % 5 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(key % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
        F.when(key % 3 != 0, F.col("l_tax")).alias("l_tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"),
        "l_returnflag",
        "l_linestatus",
    )


LINEITEM_WITH_GAPS = """
  SELECT l_orderkey, l_partkey, l_suppkey,
         CAST(l_linenumber AS DOUBLE) AS l_linenumber,
         CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice,
         l_discount,
         CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS l_tax,
         l_extendedprice * (1 - l_discount) AS l_net,
         l_returnflag, l_linestatus
  FROM lineitem"""


# Orders seen as pitches: one row per order, the columns the pitch features need.
# name -> SQL both engines read alike
PITCH_COLUMNS = {
    "pitch_key": "o_orderkey",
    "home_score": "CAST(o_custkey % 9 AS BIGINT)",
    "away_score": "CAST((o_custkey + o_orderkey) % 7 AS BIGINT)",
    "on_1b": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END",
    "on_2b": "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 END",
    "on_3b": "CASE WHEN o_orderkey % 8 = 0 THEN o_custkey + 2 END",
    "balls": "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 4 AS BIGINT) END",
    "strikes": "CAST(o_custkey % 3 AS BIGINT)",
    "inning": "CAST(o_orderkey % 11 AS BIGINT)",
    "release_speed": "CASE WHEN o_orderkey % 17 <> 0 THEN 70.0E0 + o_totalprice / 20000.0E0 END",
    "release_spin_rate": "1500.0E0 + o_totalprice / 300.0E0",
    "pfx_x": "o_totalprice / 100000.0E0 - 2.0E0",
    "pfx_z": "CASE WHEN o_orderkey % 19 <> 0 THEN (o_custkey % 40) / 10.0E0 - 1.0E0 END",
    "plate_x": "o_totalprice / 250000.0E0 - 1.0E0",
    "plate_z": "1.0E0 + (o_orderkey % 35) / 10.0E0",
    "sz_top": "3.0E0 + (o_custkey % 10) / 20.0E0",
    "sz_bot": "1.4E0 + (o_custkey % 7) / 20.0E0",
    "pitcher_days_since_prev_game": "CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderkey % 9 AS BIGINT) - 1 END",
    "age_pit": "CAST(20 + o_custkey % 19 AS BIGINT)",
    "age_bat": "CASE WHEN o_orderkey % 29 <> 0 THEN CAST(20 + o_orderkey % 17 AS BIGINT) END",
    "pitcher": "o_custkey",
    "stand": "CASE WHEN o_orderkey % 31 <> 0 THEN o_orderstatus END",
    "description": "o_orderpriority",
}


def pitches_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        *[F.expr(e).alias(n) for n, e in PITCH_COLUMNS.items()]
    )


PITCHES_FROM_ORDERS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PITCH_COLUMNS.items()) + " FROM orders"
