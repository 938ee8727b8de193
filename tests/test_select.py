"""Scores of splits whose training side lacks a class."""

from pyspark.ml.classification import DecisionTreeClassifier

from tabloom.operators.prepare import Block, Preparer
from tabloom.plans.models import LABEL
from tabloom.plans.select import PreparedSplit, grid_draws, random_search, score


def _rows(spark, labels):
    return spark.createDataFrame([(i, float(i % 5), x) for i, x in enumerate(labels)], "k int, n double, y string")


def test_rows_of_an_unseen_class_count_as_wrong(spark):
    train = _rows(spark, ["a"] * 20 + ["b"] * 20)
    test = _rows(spark, ["a"] * 5 + ["b"] * 5 + ["new"] * 10 + [None] * 3)
    make = DecisionTreeClassifier(labelCol=LABEL, maxDepth=1)
    with PreparedSplit(train, test, "y", Preparer([Block("n", ["n"])])) as split:
        assert split.classes == ["a", "b"]
        assert split.test.count() == 20
        got = score(make.fit(split.train), split.test, 2)
    assert got["accuracy"] <= 0.5 and got["recall_weighted"] <= 0.5
    assert got["roc_auc_ovr"] is not None


def test_search_with_class_weights_and_refused_settings(spark):
    from tabloom.plans import models

    df = _rows(spark, ["a", "b", "b", "b"] * 15)

    def make(**settings):
        return lambda _: models.random_forest(**settings)

    grid = {"trees": [2], "depth": [2, 3], "weighted": [True, False]}
    table, best, fitted = random_search(df, "k", "y", Preparer([Block("n", ["n"])]), make, grid, draws=4, folds=2)
    assert table.count() == 4 and set(best) == set(grid) and fitted.classes == ["a", "b"]
    assert len(grid_draws(grid, 3)) == 3
