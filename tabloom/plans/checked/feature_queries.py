"""Derived features and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import expressions as ex
from tabloom.operators.features import PitchFeatures, TypeForcer
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import (
    ORDERS_WITH_GAPS,
    PITCHES_FROM_ORDERS,
    orders_with_gaps,
    pitches_from_orders,
    table,
)

_ROUNDED = ["count_leverage", "speed_spin_ratio", "break_magnitude", "sz_center", "pitch_location_from_center"]


@checked(f"""
WITH p AS ({PITCHES_FROM_ORDERS})
SELECT pitch_key, home_score - away_score AS score_diff,
  CAST(on_1b IS NOT NULL AS INTEGER) + CAST(on_2b IS NOT NULL AS INTEGER) + CAST(on_3b IS NOT NULL AS INTEGER) AS baserunners_count,
  round((balls + 1) / CAST(strikes + 1 AS DOUBLE), 9) AS count_leverage,
  round(release_spin_rate / (release_speed + 0.1E0), 9) AS speed_spin_ratio,
  round(sqrt(pfx_x * pfx_x + pfx_z * pfx_z), 9) AS break_magnitude,
  round((sz_top + sz_bot) / 2, 9) AS sz_center,
  round(sqrt(plate_x * plate_x + (plate_z - (sz_top + sz_bot) / 2) * (plate_z - (sz_top + sz_bot) / 2)), 9) AS pitch_location_from_center,
  CASE WHEN inning > 0 AND inning <= 3 THEN 'early' WHEN inning > 3 AND inning <= 6 THEN 'middle' WHEN inning > 6 THEN 'late' END AS inning_phase,
  CASE WHEN pitcher_days_since_prev_game > -1 AND pitcher_days_since_prev_game <= 3 THEN 'short_rest'
       WHEN pitcher_days_since_prev_game > 3 AND pitcher_days_since_prev_game <= 5 THEN 'normal_rest'
       WHEN pitcher_days_since_prev_game > 5 THEN 'extended_rest' END AS pitcher_rest_impact,
  coalesce(CAST(balls AS VARCHAR), 'nan') || '-' || coalesce(CAST(strikes AS VARCHAR), 'nan') AS count_state,
  age_pit - age_bat AS age_diff
FROM p""")
def engineered_features(spark: SparkSession, d: str) -> DataFrame:
    out = PitchFeatures().transform(pitches_from_orders(spark, d))
    out = out.withColumns({c: F.round(c, 9) for c in _ROUNDED})
    return out.select("pitch_key", *ex.PITCH_FEATURES)


@checked("""
SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'debt' WHEN c_acctbal <= 2500 THEN 'low'
  WHEN c_acctbal <= 7500 THEN 'middle' ELSE 'high' END AS band FROM customer""")
def right_closed_cut(spark: SparkSession, d: str) -> DataFrame:
    band = ex.cut("c_acctbal", [-ex.INF, 0, 2500, 7500, ex.INF], ["debt", "low", "middle", "high"])
    return table(spark, d, "customer").select("c_custkey", band.alias("band"))


@checked(f"""
WITH p AS ({PITCHES_FROM_ORDERS})
SELECT coalesce(CAST(balls AS VARCHAR), 'nan') || '-' || coalesce(CAST(strikes AS VARCHAR), 'nan') AS count_state,
       count(*) AS pitches FROM p GROUP BY 1""")
def count_state(spark: SparkSession, d: str) -> DataFrame:
    df = PitchFeatures().transform(pitches_from_orders(spark, d))
    return df.groupBy("count_state").agg(F.count("*").alias("pitches"))


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, coalesce(CAST(o_custkey AS VARCHAR), 'nan') AS o_custkey,
       TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS mixed FROM g""")
def forced_types(spark: SparkSession, d: str) -> DataFrame:
    raw = orders_with_gaps(spark, d).select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority"))
        .otherwise(F.col("o_orderkey").cast("string"))
        .alias("mixed"),
    )
    return TypeForcer(textCols=["o_custkey"], numericCols=["mixed", "absent"]).transform(raw)


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, coalesce(o_orderstatus, 'Unknown') AS status, coalesce(o_totalprice, 0) AS price,
       CAST(o_custkey IS NOT NULL AS INTEGER) AS has_customer FROM g""")
def filled_and_flagged(spark: SparkSession, d: str) -> DataFrame:
    return orders_with_gaps(spark, d).select(
        "o_orderkey",
        ex.fill("o_orderstatus", "Unknown").alias("status"),
        ex.fill("o_totalprice", 0.0).alias("price"),
        ex.present("o_custkey").alias("has_customer"),
    )
