"""Reports from a table of (label, prediction[, score]).

Everything starts from the confusion counts or from counts per distinct score,
so the rows are read once and combined in the tasks that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ranks import ROWS_PER_CELL, cell_splits, running_sums


def _pair_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return (
        df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction"))
        .agg(F.count("*").alias("count"))
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, count) over all pairs of classes seen, empty cells included."""
    counts = _pair_counts(df, label, prediction)
    names = counts.select(F.explode(F.array("label", "prediction")).alias("name")).distinct()
    # the columns of the matrix, one list of class names; the cells themselves are rows
    across = names.agg(F.collect_list("name").alias("names")).withColumn("__all", F.lit(0))
    cells = names.select(F.col("name").alias("label"), F.lit(0).alias("__all")).join(F.broadcast(across), "__all")
    cells = cells.select("label", F.explode("names").alias("prediction"))
    found = cells.join(counts, ["label", "prediction"], "left")
    return found.select("label", "prediction", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, tp, support, predicted, precision, recall, f1); nothing divided by nothing is 0."""
    counts = _pair_counts(df, label, prediction)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("count").alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("count").alias("predicted")),
    )
    per_class = (
        counts.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    return per_class.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy, macro and weighted averages.

    Each class row is handed to its own line and to the three summary lines, so
    the table is read once.
    """
    lines = F.array(F.col("class"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    spread = _scores(df, label, prediction).select(
        F.posexplode(lines).alias("line", "name"), "tp", "support", "precision", "recall", "f1"
    )
    total = F.sum("support")
    summed = spread.groupBy("line", "name").agg(
        total.alias("support"),
        _ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )

    def value(c: str):
        return (
            F.when(F.col("line") == 1, F.col("accuracy"))
            .when(F.col("line") == 3, F.col(f"{c}_weighted"))
            .otherwise(F.col(f"{c}_mean"))
            .alias(c)
        )

    return summed.select(F.col("name").alias("class"), *[value(c) for c in ("precision", "recall", "f1")], "support")


def summary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and weighted F1, precision and recall."""
    total = F.sum("support")

    def weighted(c):
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    return _scores(df, label, prediction).agg(
        _ratio(F.sum("tp"), total).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
    )


def misclassified(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The wrong rows with ``true_label`` and ``predicted_label``."""
    wrong = df.filter(~F.col(label).eqNullSafe(F.col(prediction)))
    return wrong.withColumns({"true_label": F.col(label), "predicted_label": F.col(prediction)})


def error_table(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(true_label, predicted_label, count) of the wrong rows, commonest first."""
    return (
        misclassified(df, label, prediction)
        .groupBy("true_label", "predicted_label")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "true_label", "predicted_label")
    )


def binarised(df: DataFrame, label: str, classes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per class."""
    return df.select(*keep, *[(F.col(label) == c).cast("int").alias(c) for c in classes])


def one_vs_rest(df: DataFrame, label: str, scores: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """(class, score, positive): each row once per class, with that class's score."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(s).cast("double").alias("score"),
                (F.col(label).cast("string") == F.lit(c)).cast("bigint").alias("positive"),
            )
            for c, s in zip(classes, scores)
        ]
    )
    return df.select(F.inline(pairs))


def probability_rows(predicted: DataFrame, label: str, classes: Sequence[str], probability: str = "probability") -> DataFrame:
    """``one_vs_rest`` of a probability vector whose slots are the classes."""
    names = [f"p{i}" for i in range(len(classes))]
    flat = predicted.select(label, vector_to_array(probability).alias("p")).select(
        label, *[F.col("p")[i].alias(n) for i, n in enumerate(names)]
    )
    return one_vs_rest(flat, label, names, classes)


def threshold_counts(scored: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """(class, score, tp, fp, positives, negatives): counts at or above each distinct score."""
    at = scored.groupBy("class", "score").agg(
        F.sum("positive").alias("pos"), F.count("*").alias("k")
    ).persist()
    sums = running_sums(
        at,
        ["class"],
        [F.desc("score")],
        "score",
        {"tp": F.col("pos"), "fp": F.col("k") - F.col("pos")},
        cell_splits(at, "score", at.count(), rows_per_cell),
        descending=True,
    )
    totals = at.groupBy("class").agg(
        F.sum("pos").alias("positives"), (F.sum("k") - F.sum("pos")).alias("negatives")
    )
    return sums.join(totals, "class").withColumns({"at_pos": F.col("pos"), "at_neg": F.col("k") - F.col("pos")}).drop("pos", "k")


def roc_points(counts: DataFrame) -> DataFrame:
    """(class, threshold, x, y): false against true positive rate; the origin has an infinite threshold."""
    points = counts.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("negatives")).alias("x"),
        F.try_divide(F.col("tp"), F.col("positives")).alias("y"),
    )
    return points.unionByName(_end(counts, F.lit(float("inf")), 0.0, 0.0))


def _end(counts: DataFrame, threshold, x: float, y: float) -> DataFrame:
    """The end point of each class's curve."""
    return counts.select("class").distinct().select(
        "class", threshold.alias("threshold"), F.lit(x).alias("x"), F.lit(y).alias("y")
    )


def roc_areas(counts: DataFrame) -> DataFrame:
    """(class, auc). A step's trapezoid needs only its own counts, so no row looks at the one before."""
    step = F.col("at_neg") * (F.col("tp") - F.col("at_pos") / 2)
    return counts.groupBy("class").agg(
        F.try_divide(F.sum(step), F.first("positives").cast("double") * F.first("negatives")).alias("auc")
    )


def roc_macro(counts: DataFrame) -> DataFrame:
    """One row: the mean area over the classes that have one, and how many have none.

    A class without positives or without negatives has no area.
    """
    return roc_areas(counts).agg(
        F.avg("auc").alias("roc_auc_ovr"), F.count_if(F.col("auc").isNull()).alias("classes_without_area")
    )


def pr_points(counts: DataFrame) -> DataFrame:
    """(class, threshold, x, y): recall against precision; the end point (0, 1) has no threshold."""
    points = counts.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("positives")).alias("x"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("y"),
    )
    return points.unionByName(_end(counts, F.lit(None).cast("double"), 0.0, 1.0))


def pr_areas(counts: DataFrame) -> DataFrame:
    """(class, area): trapezoids between neighbouring points; the curve starts at recall 0, precision 1.

    The point before a threshold has the counts less those at the threshold.
    """
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("at_pos"), fp - F.col("at_neg")
    here = F.try_divide(tp, tp + fp)
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    part = F.try_divide(F.col("at_pos"), F.col("positives")) * (here + before) / 2
    return counts.groupBy("class").agg(F.sum(part).alias("area"))


def evaluation(
    predicted: DataFrame, label: str, prediction: str, classes: Sequence[str], probability: str | None = "probability"
) -> dict[str, DataFrame]:
    """Every report over one prediction frame, which is kept while they are read."""
    frame = predicted.persist()
    out = {
        "classification_report": class_report(frame, label, prediction),
        "confusion_matrix": confusion(frame, label, prediction),
        "errors": error_table(frame, label, prediction),
    }
    if probability is not None and probability in frame.columns:
        scored = probability_rows(frame, label, classes, probability)
        if len(classes) == 2:
            scored = scored.filter(F.col("class") == classes[1])
        counts = threshold_counts(scored)
        out["roc"], out["roc_auc"] = roc_points(counts), roc_areas(counts)
        if len(classes) == 2:
            out["precision_recall"], out["precision_recall_auc"] = pr_points(counts), pr_areas(counts)
    return out
