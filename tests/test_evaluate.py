from pyspark.sql import functions as F

from tabloom.operators import evaluate


def test_report(spark):
    df = spark.createDataFrame(list(zip("aaabb", "aabba")), "y string, p string")
    got = {r["class"]: r for r in evaluate.class_report(df, "y", "p").collect()}
    assert [round(got["a"][k], 3) for k in ("precision", "recall", "f1")] == [0.667] * 3
    assert [got["b"][k] for k in ("precision", "recall", "f1")] == [0.5] * 3
    assert round(got["accuracy"].f1, 9) == 0.6
    assert round(got["macro avg"].f1, 6) == 0.583333
    assert round(got["weighted avg"].f1, 9) == 0.6
    assert got["a"].support == 3 and got["macro avg"].support == 5
    cells = {(r.label, r.prediction): r["count"] for r in evaluate.confusion(df, "y", "p").collect()}
    assert cells == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 1}


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "c")], "y string, p string")
    got = {r["class"]: r for r in evaluate.class_report(df, "y", "p").collect()}
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, 0.0)
    assert (got["c"].support, got["c"].recall) == (0, 0.0)
    assert len(evaluate.confusion(df, "y", "p").collect()) == 9


def test_empty(spark):
    df = spark.createDataFrame([], "y string, p string")
    assert evaluate.confusion(df, "y", "p").count() == 0
    assert evaluate.summary_metrics(df, "y", "p").first().accuracy == 0.0


def test_areas(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, positive long")
    counts = evaluate.threshold_counts(df.withColumn("class", F.lit("c")))
    assert evaluate.roc_areas(counts).first().auc == 0.75
    # points (0,1) (.5,1) (.5,.5) (1,2/3) (1,.5)
    assert abs(evaluate.pr_areas(counts).first().area - (0.5 + 0 + 0.5 * (0.5 + 2 / 3) / 2)) < 1e-12
    one = evaluate.threshold_counts(df.filter("positive = 1").withColumn("class", F.lit("c")))
    assert evaluate.roc_areas(one).first().auc is None


def test_areas_in_cells(spark):
    rows = spark.range(500).select(
        F.lit("c").alias("class"), ((F.col("id") * 37 % 211) / 211).alias("score"), (F.col("id") % 3 == 0).cast("long").alias("positive")
    )
    plain = evaluate.threshold_counts(rows)
    cells = evaluate.threshold_counts(rows, rows_per_cell=10)
    assert sorted(map(tuple, plain.select(sorted(plain.columns)).collect())) == sorted(map(tuple, cells.select(sorted(cells.columns)).collect()))


def test_misclassified_counts_missing_predictions(spark):
    df = spark.createDataFrame([("a", None), ("a", "a"), ("b", "a")], "y string, p string")
    assert evaluate.misclassified(df, "y", "p").count() == 2
