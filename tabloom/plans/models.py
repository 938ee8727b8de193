"""Classifiers, prepared and fitted as one pipeline, and two-stage prediction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.prepare import Preparer
from tabloom.operators.sample import with_class_weights
from tabloom.plans.ensembles import Boosting, Forest
from tabloom.plans.logistic import Logistic
from tabloom.plans.network import Perceptron
from tabloom.session import kept_spread

LABEL, WEIGHT, PREDICTED = "label_index", "class_weight", "predicted"


def random_forest(
    trees: int = 100,
    depth: int | None = None,
    leaf: int = 1,
    seed: int = 42,
    weighted: bool = False,
    bins: int = 32,
    split: int = 2,
) -> Forest:
    """Random forest. ``depth`` None grows nodes until they are pure or smaller than ``split``.

    ``bins`` is the number of split candidates of a feature of more values.
    """
    return Forest(trees, depth, split, leaf, bins=bins, seed=seed, label=LABEL, weight=WEIGHT if weighted else None)


def extra_trees(
    trees: int = 100, depth: int | None = None, leaf: int = 1, seed: int = 42, weighted: bool = False, bins: int = 255, split: int = 2
) -> Forest:
    """Every tree sees all rows; a node draws one threshold for each feature it looks at and takes the best."""
    weight = WEIGHT if weighted else None
    return Forest(trees, depth, split, leaf, drawn=True, bootstrap=False, bins=bins, seed=seed, label=LABEL, weight=weight)


def logistic_regression(rows: int, iterations: int = 1000) -> Logistic:
    """Multinomial; the penalty matches C = 1 on a summed loss."""
    return Logistic(1.0 / max(rows, 1), iterations, label=LABEL)


def boosted_trees(rounds: int = 100, depth: int = 3, step: float = 0.1, leaf: int = 1, bins: int = 32) -> Boosting:
    """One boosted model of all classes on the softmax loss."""
    return Boosting(rounds, depth, step, leaf, bins, LABEL)


def perceptron(hidden: Sequence[int] = (64, 32), iterations: int = 500, seed: int = 42, **more) -> Perceptron:
    """Feed-forward network of rectified units, fitted by Adam in mini-batches for so many passes at most."""
    return Perceptron(tuple(hidden), iterations, seed=seed, label=LABEL, **more)


def label_counts(df: DataFrame, label: str) -> dict[str, int]:
    """Class -> rows, classes in sorted order; the classes are the width of the model's output."""
    counts = df.groupBy(F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n"))
    return {r["c"]: r["n"] for r in sorted(counts.collect(), key=lambda r: r["c"] or "") if r["c"] is not None}


def label_indexer(
    df: DataFrame, label: str, classes: Sequence[str] | None = None, unknown: str = "error"
) -> StringIndexerModel:
    """Classes in sorted order to 0..k-1.

    ``unknown`` says what becomes of other classes: an error on the side that is
    learned from, "keep" as class k on a side that is scored, where no
    prediction can be right.
    """
    names = list(label_counts(df, label)) if classes is None else list(classes)
    return StringIndexerModel.from_labels(names, label, LABEL, unknown)


def balanced_weight(counts: dict[str, int]) -> Column:
    """Weight of each row's class from its index: rows / (classes x class rows)."""
    rows = sum(counts.values())
    weights = F.array(*[F.lit(rows / (len(counts) * n)) for n in counts.values()])
    return weights[F.col(LABEL).cast("int")]


@dataclass
class Fitted:
    """A prepared and fitted classifier that predicts class names."""

    model: PipelineModel
    classes: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def classifier(self) -> Model:
        return next(s for s in reversed(self.model.stages) if not isinstance(s, IndexToString))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "Fitted":
        model = PipelineModel.load(path)
        return cls(model, list(model.stages[-1].getLabels()))


def fit(
    train: DataFrame,
    label: str,
    preparer: Preparer,
    classifier: Callable[[DataFrame], object],
    weighted: bool = False,
    balance: Callable[[DataFrame], DataFrame] | None = None,
    before: Sequence = (),
) -> Fitted:
    """Learn the preparation and the classifier from the training side.

    ``before`` are feature stages run first. ``balance`` changes the prepared
    training rows only; it is not part of the fitted model, so prediction sees
    the rows as they are. ``classifier`` is called with the prepared frame.
    """
    known = train.filter(F.col(label).isNotNull())
    made = PipelineModel(list(before)).transform(known) if before else known
    prepared = preparer.fit(made)
    counts = label_counts(made, label)
    indexer = label_indexer(made, label, list(counts))
    ready = indexer.transform(prepared.transform(made))
    if balance is not None:
        ready = balance(ready)
        if weighted:
            ready = with_class_weights(ready, LABEL, WEIGHT)
    elif weighted:
        ready = ready.withColumn(WEIGHT, balanced_weight(counts))
    kept = [c for c in (LABEL, WEIGHT, preparer.output) if c in ready.columns]
    rows = kept_spread(ready.select(*kept))
    try:
        fitted = classifier(rows).fit(rows)
    finally:
        rows.unpersist()
    names = IndexToString(inputCol="prediction", outputCol=PREDICTED, labels=indexer.labels)
    return Fitted(PipelineModel([*before, prepared, fitted, names]), list(indexer.labels))


def two_stage(df: DataFrame, first: str, wanted: str, second: str, output: str) -> DataFrame:
    """Keep the second answer only where the first one is the wanted class."""
    return df.withColumn(output, F.when(F.col(first) == wanted, F.col(second)))


@dataclass
class TwoStage:
    """First model says what happens; the second says where, for one outcome only."""

    first: Fitted
    second: Fitted
    wanted: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted_type`` and ``predicted_place``; the second model scores every row, in one pass."""
        plain = df.columns
        typed = self.first.predict(df).select(*plain, F.col(PREDICTED).alias("predicted_type"))
        placed = self.second.predict(typed).select(*plain, "predicted_type", F.col(PREDICTED).alias("__place"))
        return two_stage(placed, "predicted_type", self.wanted, "__place", "predicted_place").drop("__place")


def fit_two_stage(
    train: DataFrame, outcome: str, place: str, wanted: str, preparer: Preparer, classifier: Callable
) -> TwoStage:
    """The second model learns from rows of the wanted outcome only; both share one split."""
    first = fit(train, outcome, preparer, classifier)
    rows = train.filter(F.col(outcome) == wanted)
    known = rows.withColumn(place, F.coalesce(F.col(place).cast("string"), F.lit("Unknown")))
    return TwoStage(first, fit(known, place, preparer, classifier), wanted)


def class_probabilities(predicted: DataFrame, classes: Sequence[str], keep: Sequence[Column | str]) -> DataFrame:
    """One probability column per class."""
    from pyspark.ml.functions import vector_to_array

    flat = predicted.withColumn("__p", vector_to_array("probability"))
    return flat.select(*keep, *[F.col("__p")[i].alias(c) for i, c in enumerate(classes)])
