"""Evaluation of a rule-based prediction, so that SQL can follow every number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import evaluate
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import table
from tabloom.plans.checked.profile_queries import union_over

_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STEP = 1 / 5

# A stand-in prediction both engines compute alike: right on two keys in three.
_GUESS = "1 + (o_orderkey + CAST(floor(o_totalprice) AS BIGINT)) % 4"


def _score(i: int) -> str:
    """Score of class i: coarse, so that many rows tie."""
    return (
        f"CAST((CASE WHEN substr(o_orderpriority, 1, 1) = '{i + 1}' THEN 30 ELSE 0 END + "
        f"(o_orderkey * {7 + i} + o_custkey) % 101) AS DOUBLE) / 200"
    )


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    number = F.expr(_GUESS)
    guess = F.array(*[F.lit(c) for c in _CLASSES])[number.cast("int")]
    return orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("label"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(guess).alias("prediction"),
        *[F.expr(_score(i)).alias(f"s{i}") for i in range(5)],
    )


_GUESSED = (
    "SELECT o_orderkey, o_orderpriority AS label, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE list_extract(["
    + ", ".join(f"'{c}'" for c in _CLASSES)
    + f"], CAST({_GUESS} AS INTEGER) + 1) END AS prediction, "
    + ", ".join(f"{_score(i)} AS s{i}" for i in range(5))
    + " FROM orders"
)

_CELLS = (
    f"g AS ({_GUESSED}), n AS (SELECT DISTINCT label AS c FROM g UNION SELECT DISTINCT prediction FROM g), "
    "m AS (SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM g WHERE g.label = a.c AND g.prediction = b.c) AS count FROM n a, n b)"
)
_BY_CLASS = (
    f"{_CELLS}, s AS (SELECT c AS class, (SELECT count(*) FROM g WHERE label = c AND prediction = c) AS tp, "
    "(SELECT count(*) FROM g WHERE label = c) AS support, (SELECT count(*) FROM g WHERE prediction = c) AS predicted FROM n), "
    "t AS (SELECT class, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS p, "
    "CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS r, 2 * tp / CAST(predicted + support AS DOUBLE) AS f, support, tp FROM s)"
)


@checked(f"WITH {_CELLS} SELECT label, prediction, count FROM m")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_guessed(spark, d), "label", "prediction")


@checked(f"""
WITH {_BY_CLASS}, u AS (
SELECT class, p AS precision, r AS recall, f AS f1, support FROM t UNION ALL
SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM t UNION ALL
SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM t UNION ALL
SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM t)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.class_report(_guessed(spark, d), "label", "prediction")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@checked(f"""
WITH {_BY_CLASS}
SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(sum(f * support) / sum(support), 9) AS f1_weighted,
       round(sum(p * support) / sum(support), 9) AS precision_weighted, round(sum(r * support) / sum(support), 9) AS recall_weighted FROM t""")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.summary_metrics(_guessed(spark, d), "label", "prediction")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@checked(f"""
WITH g AS ({_GUESSED}) SELECT o_orderkey, label AS true_label, prediction AS predicted_label FROM g WHERE label <> prediction""")
def misclassified_rows(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.misclassified(_guessed(spark, d), "label", "prediction")
    return out.select("o_orderkey", "true_label", "predicted_label")


@checked(f"""
WITH g AS ({_GUESSED})
SELECT label AS true_label, prediction AS predicted_label, count(*) AS count FROM g WHERE label <> prediction GROUP BY 1, 2""")
def error_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.error_table(_guessed(spark, d), "label", "prediction")


_THRESHOLDS = (
    f"g AS ({_GUESSED}), v AS ("
    + union_over(range(5), lambda i: f"SELECT '{_CLASSES[i]}' AS class, s{i} AS score, CAST(label = '{_CLASSES[i]}' AS INTEGER) AS pos FROM g")
    + "), k AS (SELECT class, score, sum(pos) AS pos, count(*) - sum(pos) AS neg FROM v GROUP BY 1, 2), "
    "c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM k "
    "WINDOW w AS (PARTITION BY class ORDER BY score DESC), a AS (PARTITION BY class)), "
    "l AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0, "
    "coalesce(lag(tp / (tp + fp)) OVER w, 1) AS pr0 FROM c WINDOW w AS (PARTITION BY class ORDER BY score DESC))"
)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_counts(
        evaluate.one_vs_rest(_guessed(spark, d), "label", [f"s{i}" for i in range(5)], _CLASSES)
    )


@checked(
    f"WITH {_THRESHOLDS} SELECT class, score AS threshold, round(fp / n, 9) AS x, round(tp / p, 9) AS y FROM c "
    "UNION ALL SELECT DISTINCT class, CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c"
)
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_points(_counts(spark, d)).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


@checked(f"WITH {_THRESHOLDS} SELECT class, round(sum((fp - fp0) / n * (tp + tp0) / p / 2), 9) AS auc FROM l GROUP BY 1")
def roc_auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_areas(_counts(spark, d)).withColumn("auc", F.round("auc", 9))


@checked(
    f"WITH {_THRESHOLDS} SELECT round(avg(auc), 9) AS roc_auc_ovr, count(*) - count(auc) AS classes_without_area FROM "
    "(SELECT class, sum((fp - fp0) / n * (tp + tp0) / p / 2) AS auc FROM l GROUP BY 1)"
)
def roc_auc_macro(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_macro(_counts(spark, d)).withColumn("roc_auc_ovr", F.round("roc_auc_ovr", 9))


@checked(
    f"WITH {_THRESHOLDS} SELECT class, score AS threshold, round(tp / p, 9) AS x, round(tp / (tp + fp), 9) AS y FROM c "
    "UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM c"
)
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pr_points(_counts(spark, d)).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


@checked(f"WITH {_THRESHOLDS} SELECT class, round(sum((tp - tp0) / p * (tp / (tp + fp) + pr0) / 2), 9) AS area FROM l GROUP BY 1")
def pr_area(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pr_areas(_counts(spark, d)).withColumn("area", F.round("area", 9))


@checked(
    f"WITH g AS ({_GUESSED}) SELECT o_orderkey, "
    + ", ".join(f"CAST(label = '{c}' AS INTEGER) AS \"{c}\"" for c in _CLASSES)
    + " FROM g"
)
def label_binarised(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.binarised(_guessed(spark, d), "label", _CLASSES, ["o_orderkey"])


@checked("""
WITH p AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_quantity > 25 THEN 'R' WHEN l_discount > 0.05 THEN 'N' ELSE 'A' END AS type_of,
  CASE WHEN l_tax > 0.04 THEN 'O' ELSE 'F' END AS place FROM lineitem)
SELECT l_returnflag, type_of, CASE WHEN type_of = 'R' THEN place END AS location, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def two_stage_rule(spark: SparkSession, d: str) -> DataFrame:
    """Second answer only where the first one is the wanted class; stand-in rules for the models."""
    from tabloom.plans.models import two_stage

    lines = table(spark, d, "lineitem").withColumns(
        {
            "type_of": F.when(F.col("l_quantity") > 25, "R").when(F.col("l_discount") > 0.05, "N").otherwise("A"),
            "place": F.when(F.col("l_tax") > 0.04, "O").otherwise("F"),
        }
    )
    out = two_stage(lines, "type_of", "R", "place", "location")
    return out.groupBy("l_returnflag", "type_of", "location").agg(F.count("*").alias("n"))
