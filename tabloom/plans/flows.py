"""End-to-end runs: roles, preparation, split, fit and report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import evaluate, roles, screen
from tabloom.operators.aggregate import numeric_columns
from tabloom.operators.features import PitchFeatures
from tabloom.operators.information import neighbour_information
from tabloom.operators.prepare import Block, Preparer, feature_names
from tabloom.operators.roles import FeatureGroups
from tabloom.operators.sample import fraction_sample, random_split, sides, stratified_split
from tabloom.plans import models
from tabloom.plans.models import PREDICTED, Fitted
from tabloom.plans.select import importances, random_search


@dataclass
class Run:
    """A fitted run and its reports."""

    fitted: Fitted
    report: DataFrame
    importance: DataFrame | None
    search: DataFrame | None = None


def pitch_key(game="game_pk", at_bat="at_bat_number", pitch="pitch_number"):
    """Unique text key of a pitch."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in (game, at_bat, pitch)])


# ---------------------------------------------------------------- block layouts

# fixed values: block names appear in output names, and the bounds decide the slots


def hashed_blocks(g: FeatureGroups) -> list[Block]:
    """Commonest-value imputing throughout; capped one-hot categories; player ids hashed into 32 counters."""
    return [
        Block("cont", g.continuous, "most_frequent", scale="standard"),
        Block("disc", g.discrete, "most_frequent"),
        Block("OH", g.categorical, "most_frequent", encode="onehot", max_categories=200),
        Block("Hash", g.hashed, encode="hash", buckets=32),
    ]


def counted_blocks(g: FeatureGroups) -> list[Block]:
    """Ids by row count, bases by presence, measures by mean, counts by commonest value."""
    return [
        Block("cat", g.categorical, "most_frequent", encode="onehot"),
        Block("id", g.identifying, encode="frequency"),
        Block("disc", g.discrete, "most_frequent", scale="standard"),
        Block("cont", g.continuous, "mean", scale="standard"),
        Block("id_flags", g.id_flags, encode="presence"),
    ]


def robust_blocks(g: FeatureGroups) -> list[Block]:
    """Ids by share, measures by median and quartile range, two-valued categories in one slot."""
    return [
        Block("cat", g.categorical, "constant", fill="missing", encode="onehot"),
        Block("id", g.identifying, encode="share", min_share=0.001),
        Block("cont", g.continuous, "median", scale="robust"),
        Block("disc", g.discrete, "median", scale="standard"),
        Block("bin", g.binary, "constant", fill="missing", encode="onehot", drop_binary=True),
        Block("flag", g.id_flags, encode="presence"),
    ]


def typed_blocks(df: DataFrame, features: Sequence[str]) -> list[Block]:
    """Numbers scaled, text one-hot. Forests take no gaps, so numbers get their mean."""
    numbers = [c for c in numeric_columns(df) if c in set(features)]
    return [
        Block("num", numbers, "mean", scale="standard"),
        Block("cat", [c for c in features if c not in set(numbers)], encode="onehot"),
    ]


def ordinal_blocks(df: DataFrame, features: Sequence[str], below: int = 50) -> list[Block]:
    """Numbers scaled; text with few values by sorted code; the rest left out."""
    numbers = [c for c in numeric_columns(df) if c in set(features)]
    text = [c for c in features if c not in set(numbers)]
    low = roles.names_where(roles.cardinality_split(df.select(*text), below), F.col("role") == "kept") if text else []
    return [
        Block("num", numbers, "mean", scale="standard"),
        Block("cat", low, "most_frequent", encode="ordinal"),
    ]


def role_blocks(df: DataFrame, target: str, ids: Sequence[str]) -> list[Block]:
    """Columns sorted into numerical and categorical by their statistics."""
    table = roles.split_roles(df, target, ids).collect()
    pick = lambda role: sorted(r["column"] for r in table if r["role"] == role)
    return [
        Block("num", pick("numerical"), "mean", scale="standard"),
        Block("cat", pick("categorical"), "most_frequent", encode="onehot"),
    ]


# ---------------------------------------------------------------- runs


def _finish(fitted: Fitted, test: DataFrame, label: str, spark) -> Run:
    predicted = fitted.predict(test)
    names = feature_names(fitted.predict(test.limit(0)))
    return Run(
        fitted,
        evaluate.class_report(predicted, label, PREDICTED),
        importances(fitted.classifier, names, spark),
    )


def forest_run(
    df: DataFrame,
    key: str,
    label: str,
    blocks: Sequence[Block],
    trees: int = 100,
    depth: int | None = None,
    weighted: bool = True,
    engineered: bool = False,
    seed: int = 42,
) -> Run:
    """Stratified split, prepare on the training side, weighted forest, report and importances."""
    train, test = sides(stratified_split(df.filter(F.col(label).isNotNull()), key, label, 0.2, seed))
    before = [PitchFeatures()] if engineered else []
    make = lambda _: models.random_forest(trees, depth, seed=seed, weighted=weighted)
    fitted = models.fit(train, label, Preparer(blocks), make, weighted=weighted, before=before)
    return _finish(fitted, test, label, df.sparkSession)


def model_run(
    df: DataFrame, key: str, label: str, blocks: Sequence[Block], make: Callable, stratified: bool = True, seed: int = 42
) -> Run:
    """The same with any classifier; ``make`` is called with the prepared training rows."""
    known = df.filter(F.col(label).isNotNull())
    split = stratified_split(known, key, label, 0.2, seed) if stratified else random_split(known, key, 0.2, seed)
    train, test = sides(split)
    return _finish(models.fit(train, label, Preparer(blocks), make), test, label, df.sparkSession)


def searched_run(
    df: DataFrame,
    key: str,
    label: str,
    blocks: Sequence[Block],
    grid: Mapping[str, Sequence],
    draws: int = 5,
    folds: int = 3,
    seed: int = 42,
    parallelism: int = 2,
    sample: float | None = None,
) -> Run:
    """Random search over forests on the training side, best refitted, report on the test side.

    ``sample``: the share of the training rows that is searched on; the best
    settings are then fitted on all of them.
    """
    train, test = sides(stratified_split(df.filter(F.col(label).isNotNull()), key, label, 0.2, seed))

    def make(**settings):
        return lambda _: models.random_forest(seed=seed, **settings)

    rows = train if sample is None else fraction_sample(train, key, sample, seed)
    found, best, fitted = random_search(
        rows, key, label, Preparer(blocks), make, grid, draws, folds, seed=seed, parallelism=parallelism
    )
    if sample is not None:
        fitted = models.fit(train, label, Preparer(blocks), make(**best), weighted=bool(best.get("weighted")))
    run = _finish(fitted, test, label, df.sparkSession)
    run.search = found
    return run


def screening_run(df: DataFrame, label: str, missing: float = 0.1, distinct: int = 50, threshold: float = 0.8) -> DataFrame:
    """Sparse and id-like columns out, then information, chi-square and correlation, as one table."""
    dense = roles.drop_sparse(df, missing)
    ids = roles.id_like_columns(dense.drop(label), distinct)
    rest = dense.drop(*roles.names_where(ids))
    numbers = [c for c in numeric_columns(rest) if c != label]
    text = [c for c, t in rest.dtypes if t == "string" and c != label]
    empty = df.sparkSession.createDataFrame
    information = (
        neighbour_information(rest, numbers, label, fill_median=True)
        if numbers
        else empty([], "feature string, score double")
    )
    chi2 = screen.chi_square(rest, text, label) if text else empty([], "feature string, chi2 double")
    correlated = (
        screen.correlated_columns(rest, numbers, threshold, fill_median=True)
        if numbers
        else empty([], "column string, worst double")
    )
    return screen.selection_summary(information, chi2, ids, correlated)


