"""Cross validation, search, comparisons and feature selection.

Loops run on the driver over folds and settings; rows stay in frames. A few folds
are fitted at the same time, so that the small steps of one fill the cores that
another leaves idle; a fold's prepared rows are shared by all settings tried on
it and let go with it.
"""

from __future__ import annotations

import itertools
import json
import random
import statistics
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import evaluate
from tabloom.operators.prepare import Preparer, feature_names
from tabloom.operators.sample import repeated_folds, stratified_folds
from tabloom.plans.models import LABEL, WEIGHT, Fitted, balanced_weight, fit, label_counts, label_indexer
from tabloom.session import durable, kept_spread

METRICS = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "roc_auc_ovr")


def score(model, rows: DataFrame, classes: int, metrics: Sequence[str] = METRICS) -> dict[str, float]:
    """Metrics of a fitted classifier on prepared rows."""
    predicted = model.transform(rows)
    out = {}
    if any(m != "roc_auc_ovr" for m in metrics):
        out.update(evaluate.summary_metrics(predicted, LABEL, "prediction").first().asDict())
    if "roc_auc_ovr" in metrics:
        out["roc_auc_ovr"] = None
        if "probability" in predicted.columns:
            names = [str(float(i)) for i in range(classes)]
            rated = evaluate.probability_rows(predicted, LABEL, names)
            if classes == 2:
                rated = rated.filter(F.col("class") == names[1])
            out["roc_auc_ovr"] = evaluate.roc_macro(evaluate.threshold_counts(rated)).first()[0]
    return {m: out[m] for m in metrics}


def release(model) -> None:
    """Delete what a fitted classifier has stored, if it stores anything; its predictions go with it."""
    if hasattr(model, "release"):
        model.release()


class PreparedSplit:
    """Train and test rows of one split, prepared from the training side and kept until closed.

    A test row whose class the training side lacks stays, and counts as wrong.
    """

    def __init__(
        self,
        train: DataFrame,
        test: DataFrame,
        label: str,
        preparer: Preparer,
        keep: Sequence[str] = (),
        weighted: bool = False,
    ):
        known, asked = train.filter(F.col(label).isNotNull()), test.filter(F.col(label).isNotNull())
        self.model = preparer.fit(known)
        counts = label_counts(known, label)
        self.classes = list(counts)
        learn, judge = (label_indexer(known, label, self.classes, unknown) for unknown in ("error", "keep"))
        columns = [*keep, LABEL, preparer.output]
        rows = learn.transform(self.model.transform(known))
        if weighted:
            rows = rows.withColumn(WEIGHT, balanced_weight(counts))
        self.train = kept_spread(rows.select(*columns, *([WEIGHT] if weighted else [])))
        self.test = kept_spread(judge.transform(self.model.transform(asked)).select(*columns))
        self.names = feature_names(self.train, preparer.output)

    def __enter__(self) -> "PreparedSplit":
        return self

    def __exit__(self, *_) -> None:
        self.train.unpersist()
        self.test.unpersist()


def _at_once(spark, run: Callable, items: Sequence, parallelism: int) -> list:
    """Results of ``run`` over the items, in their order, some at the same time."""
    with ThreadPool(max(1, parallelism)) as pool:
        return pool.map(inheritable_thread_target(spark)(run), items, chunksize=1)


def _fold_splits(folded: DataFrame, column: str, folds: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    for i in range(folds):
        yield i, folded.filter(F.col(column) != i), folded.filter(F.col(column) == i)


def cross_validate(
    df: DataFrame,
    key: str,
    label: str,
    preparer: Preparer,
    make: Callable[[DataFrame], object],
    folds: int = 5,
    repeats: int = 1,
    metrics: Sequence[str] = METRICS,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """(metric, side, mean, std): metrics on the training and test sides of every fold of every repeat."""
    folded = durable(repeated_folds(df.filter(F.col(label).isNotNull()), key, label, folds, repeats, seed))

    def run(fold: tuple[DataFrame, DataFrame]) -> dict[str, dict[str, float]]:
        with PreparedSplit(*fold, label, preparer) as split:
            model = make(split.train).fit(split.train)
            sides = {"train": split.train, "test": split.test}
            got = {side: score(model, rows, len(split.classes), metrics) for side, rows in sides.items()}
            release(model)
            return got

    splits = [(train, test) for r in range(repeats) for _, train, test in _fold_splits(folded, f"fold_{r}", folds)]
    got: dict[tuple[str, str], list[float]] = {}
    for scores in _at_once(df.sparkSession, run, splits, parallelism):
        for side, values in scores.items():
            for m, v in values.items():
                if v is not None:
                    got.setdefault((m, side), []).append(float(v))
    rows = [(m, s, statistics.fmean(v), statistics.pstdev(v), len(v)) for (m, s), v in got.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, side string, mean double, std double, folds int")


def grid_draws(grid: Mapping[str, Sequence], draws: int, seed: int = 42) -> list[dict]:
    """Distinct settings drawn from the product of a grid; all of them if it is smaller."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return points if draws >= len(points) else random.Random(seed).sample(points, draws)


def random_search(
    df: DataFrame,
    key: str,
    label: str,
    preparer: Preparer,
    make: Callable[..., object],
    grid: Mapping[str, Sequence],
    draws: int,
    folds: int,
    metric: str = "f1_weighted",
    seed: int = 42,
    parallelism: int = 2,
) -> tuple[DataFrame, dict, Fitted]:
    """Cross-validate drawn settings, then refit the best on all rows.

    ``make`` takes the settings as keywords and gives a function of the prepared
    frame; a setting ``weighted`` weighs the rows by class. Returns (results, best settings, refitted model); results have
    (params, mean, std, rank, seconds).
    """
    tried = grid_draws(grid, draws, seed)
    folded = durable(stratified_folds(df.filter(F.col(label).isNotNull()), key, label, folds, seed))
    scores: list[list[float]] = [[] for _ in tried]
    seconds = [0.0 for _ in tried]
    for _, train, test in _fold_splits(folded, "fold", folds):
        with PreparedSplit(train, test, label, preparer, weighted=any(grid.get("weighted", []))) as split:

            def run(i: int) -> None:
                start = time.perf_counter()
                model = make(**tried[i])(split.train).fit(split.train)
                scores[i].append(score(model, split.test, len(split.classes), [metric])[metric])
                release(model)
                seconds[i] += time.perf_counter() - start

            _at_once(df.sparkSession, run, range(len(tried)), parallelism)
    means = [statistics.fmean(s) for s in scores]
    order = sorted(range(len(tried)), key=lambda i: (-means[i], i))
    rank = {i: n + 1 for n, i in enumerate(order)}
    rows = [
        (json.dumps(p, sort_keys=True), metric, means[i], statistics.pstdev(scores[i]), rank[i], seconds[i])
        for i, p in enumerate(tried)
    ]
    schema = "params string, metric string, mean double, std double, rank int, seconds double"
    best = tried[order[0]]
    fitted = fit(df, label, preparer, make(**best), weighted=bool(best.get("weighted")))
    return df.sparkSession.createDataFrame(rows, schema), best, fitted


def compare_models(
    train: DataFrame, test: DataFrame, label: str, preparer: Preparer, makers: Mapping[str, Callable]
) -> DataFrame:
    """(name, four metrics, seconds) of each model on one prepared split."""
    rows = []
    with PreparedSplit(train, test, label, preparer) as split:
        for name, make in makers.items():
            start = time.perf_counter()
            model = make(split.train).fit(split.train)
            got = score(model, split.test, len(split.classes), METRICS[:4])
            rows.append((name, *[got[m] for m in METRICS[:4]], time.perf_counter() - start))
            release(model)
    schema = "name string, " + ", ".join(f"{m} double" for m in METRICS[:4]) + ", seconds double"
    return train.sparkSession.createDataFrame(rows, schema)


def compare_balancing(
    train: DataFrame, test: DataFrame, key: str, label: str, preparer: Preparer, make: Callable, seed: int = 42
) -> DataFrame:
    """(name, four metrics, training rows) without balancing and with each strategy."""
    from tabloom.operators.balance import Balancer

    rows = []
    with PreparedSplit(train, test, label, preparer, [key]) as split:
        for name in ("none", "smote", "oversample", "undersample"):
            side = split.train
            if name != "none":
                side = durable(Balancer(name, key, LABEL, preparer.output, seed)(side))
            model = make(side).fit(side)
            got = score(model, split.test, len(split.classes), METRICS[:4])
            rows.append((name, *[got[m] for m in METRICS[:4]], side.count()))
            release(model)
    schema = "name string, " + ", ".join(f"{m} double" for m in METRICS[:4]) + ", train_rows long"
    return train.sparkSession.createDataFrame(rows, schema)


def compare_feature_sets(
    df: DataFrame,
    key: str,
    label: str,
    sets: Mapping[str, Preparer],
    make: Callable,
    folds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(name, mean, std): cross-validated accuracy of each named feature set."""
    parts = []
    for name, preparer in sets.items():
        got = cross_validate(df, key, label, preparer, make, folds, metrics=["accuracy"], seed=seed)
        parts.append(got.filter(F.col("side") == "test").select(F.lit(name).alias("name"), "mean", "std"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(classifier, names: Sequence[str], spark) -> DataFrame | None:
    """(feature, importance), largest first; None for a model without importances."""
    if not hasattr(classifier, "featureImportances"):
        return None
    values = classifier.featureImportances.toArray().tolist()
    if len(values) != len(names):
        names = [f"feature_{i}" for i in range(len(values))]
    rows = sorted(zip(names, values), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def select_by_importance(classifier) -> list[int]:
    """Slots whose importance is at least the median."""
    values = classifier.featureImportances.toArray().tolist()
    least = statistics.median(values)
    return [i for i, v in enumerate(values) if v >= least]


def keep_slots(df: DataFrame, slots: Sequence[int], features: str = "features") -> DataFrame:
    """The vector column cut down to the given slots."""
    if not slots:
        raise ValueError("no slots to keep")
    cut = VectorSlicer(inputCol=features, outputCol="__cut", indices=list(slots)).transform(df)
    return cut.drop(features).withColumnRenamed("__cut", features)


def _eliminate(train: DataFrame, slots: list[int], make, floor: int, step: int, features: str):
    """Yield (slots, model) while dropping the weakest slots, down to the floor."""
    while True:
        rows = keep_slots(train, slots, features)
        model = make(rows).fit(rows)
        yield slots, model
        if len(slots) <= floor:
            release(model)
            return
        weight = model.featureImportances.toArray().tolist()
        release(model)
        drop = min(step, len(slots) - floor)
        weakest = sorted(range(len(slots)), key=lambda i: (weight[i], i))[:drop]
        slots = [s for i, s in enumerate(slots) if i not in set(weakest)]


def recursive_elimination(
    df: DataFrame,
    key: str,
    label: str,
    preparer: Preparer,
    make: Callable,
    folds: int = 5,
    floor: int = 10,
    step: int = 1,
    metric: str = "f1_weighted",
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[DataFrame, list[str]]:
    """Drop the weakest features round by round; keep the size that cross-validates best.

    Returns ((features, mean, std), names kept). The vector is prepared once from
    all rows, so every fold eliminates among the same slots.
    """
    known = df.filter(F.col(label).isNotNull())
    prepared = label_indexer(known, label).transform(preparer.fit(known).transform(known))
    names = feature_names(prepared, preparer.output)
    folded = stratified_folds(prepared.select(key, LABEL, preparer.output), key, LABEL, folds, seed)
    rows = durable(folded)
    # the checkpointed copy keeps values, not slot names, which are held here
    slots, classes = list(range(len(names))), known.select(label).distinct().count()

    def run(fold: tuple[DataFrame, DataFrame]) -> dict[int, float]:
        train, test = (kept_spread(side) for side in fold)
        got = {}
        for kept, model in _eliminate(train, slots, make, floor, step, preparer.output):
            seen = keep_slots(test, kept, preparer.output)
            got[len(kept)] = score(model, seen, classes, [metric])[metric]
        train.unpersist()
        test.unpersist()
        return got

    by_size: dict[int, list[float]] = {}
    for got in _at_once(df.sparkSession, run, [(train, test) for _, train, test in _fold_splits(rows, "fold", folds)], parallelism):
        for n, v in got.items():
            by_size.setdefault(n, []).append(v)
    means = {n: statistics.fmean(v) for n, v in by_size.items()}
    best = min(means, key=lambda n: (-means[n], n))
    chosen = slots
    for kept, _ in _eliminate(rows, slots, make, best, step, preparer.output):
        chosen = kept
    curve = [(n, means[n], statistics.pstdev(v)) for n, v in sorted(by_size.items())]
    spark = df.sparkSession
    return spark.createDataFrame(curve, "features int, mean double, std double"), [names[i] for i in chosen]


