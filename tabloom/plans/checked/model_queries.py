"""Models, selection and balancing over orders seen as pitches, and over the embeddings."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import evaluate
from tabloom.operators.balance import smote
from tabloom.operators.neighbours import nearest_rows
from tabloom.operators.prepare import Block, Preparer, feature_names
from tabloom.operators.roles import FeatureGroups
from tabloom.operators.sample import sides, stratified_split
from tabloom.operators.trees import node_key, uniform
from tabloom.plans import flows, models, select
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import PITCHES_FROM_ORDERS, pitches_from_orders, table
from tabloom.plans.checked.sampling_queries import ranked_sql
from tabloom.plans.ensembles import Boosting, Forest
from tabloom.plans.network import Layers, NetworkModel
from tabloom.session import ensure_checkpoint_dir

KEY, LABEL = "pitch_key", "description"

GROUPS = FeatureGroups(
    target=LABEL,
    categorical=("stand",),
    identifying=("pitcher",),
    id_flags=("on_1b", "on_2b", "on_3b"),
    discrete=("balls", "strikes", "inning", "home_score", "away_score", "age_pit", "age_bat"),
    continuous=("release_speed", "release_spin_rate", "pfx_x", "pfx_z", "plate_x", "plate_z", "sz_top", "sz_bot"),
    hashed=("pitcher", "on_1b", "on_2b", "on_3b"),
)


def _pitches(spark: SparkSession, d: str) -> DataFrame:
    """The pitch view with an outcome that depends on it, so models have something to find."""
    speed = F.coalesce("release_speed", F.lit(80.0))
    outcome = (
        F.when((F.col("strikes") == 2) & (speed > 85), "swinging_strike")
        .when(F.col("plate_z") > 3.4, "ball")
        .when(F.col("plate_x") < -0.4, "foul")
        .when(F.col("pitch_key") % 9 == 0, "ball")
        .otherwise("called_strike")
    )
    return pitches_from_orders(spark, d).withColumn(LABEL, outcome)


def _forest(trees: int = 100, depth: int | None = None):
    return lambda _: models.random_forest(trees, depth)


@checked()
def forest_report(spark: SparkSession, d: str) -> DataFrame:
    return flows.forest_run(_pitches(spark, d), KEY, LABEL, flows.hashed_blocks(GROUPS)).report


@checked()
def forest_importances(spark: SparkSession, d: str) -> DataFrame:
    run = flows.forest_run(_pitches(spark, d), KEY, LABEL, flows.counted_blocks(GROUPS))
    return run.importance


@checked()
def engineered_forest_report(spark: SparkSession, d: str) -> DataFrame:
    """Feature step first, inside the fitted pipeline."""
    more = [
        *flows.counted_blocks(GROUPS),
        Block("made", ["count_leverage", "break_magnitude", "pitch_location_from_center"], "mean", scale="standard"),
        Block("state", ["inning_phase", "count_state"], encode="onehot"),
    ]
    return flows.forest_run(_pitches(spark, d), KEY, LABEL, more, engineered=True).report


@checked()
def baseline_forest_report(spark: SparkSession, d: str) -> DataFrame:
    df = _pitches(spark, d)
    features = [*GROUPS.continuous, *GROUPS.discrete, *GROUPS.categorical]
    return flows.forest_run(df, KEY, LABEL, flows.typed_blocks(df, features)).report


@checked()
def ordinal_forest_report(spark: SparkSession, d: str) -> DataFrame:
    df = _pitches(spark, d)
    features = [*GROUPS.continuous, *GROUPS.discrete, *GROUPS.categorical]
    return flows.model_run(df, KEY, LABEL, flows.ordinal_blocks(df, features), _forest(), stratified=False).report


@checked()
def extra_trees_report(spark: SparkSession, d: str) -> DataFrame:
    make = lambda _: models.extra_trees()
    return flows.model_run(_pitches(spark, d), KEY, LABEL, flows.counted_blocks(GROUPS), make).report


@checked()
def logreg_report(spark: SparkSession, d: str) -> DataFrame:
    make = lambda rows: models.logistic_regression(rows.count())
    return flows.model_run(_pitches(spark, d), KEY, LABEL, flows.counted_blocks(GROUPS), make).report


@checked()
def boosted_report(spark: SparkSession, d: str) -> DataFrame:
    make = lambda _: models.boosted_trees()
    return flows.model_run(_pitches(spark, d), KEY, LABEL, flows.counted_blocks(GROUPS), make).report


@checked()
def mlp_report(spark: SparkSession, d: str) -> DataFrame:
    """Columns sorted by statistics, two hidden layers, plain random split."""
    df = _pitches(spark, d).drop("on_1b", "on_2b", "on_3b")
    blocks = flows.role_blocks(df, LABEL, [KEY, "pitcher"])
    return flows.model_run(df, KEY, LABEL, blocks, lambda _: models.perceptron(), stratified=False).report


@checked()
def two_stage_models(spark: SparkSession, d: str) -> DataFrame:
    """Outcome first; for one outcome only, a second model says where."""
    df = _pitches(spark, d).withColumn(
        "hit_location", F.when(F.col(LABEL) == "foul", (F.col("inning") % 3 + 7).cast("string"))
    )
    train, test = sides(stratified_split(df, KEY, LABEL))
    model = models.fit_two_stage(
        train, LABEL, "hit_location", "foul", Preparer(flows.counted_blocks(GROUPS)), _forest()
    )
    out = model.predict(test)
    return out.groupBy(LABEL, "predicted_type", "predicted_place").agg(F.count("*").alias("n"))


@checked()
def class_probability_means(spark: SparkSession, d: str) -> DataFrame:
    df = _pitches(spark, d)
    train, test = sides(stratified_split(df, KEY, LABEL))
    fitted = models.fit(train, LABEL, Preparer(flows.counted_blocks(GROUPS)), _forest())
    out = models.class_probabilities(fitted.predict(test), fitted.classes, [LABEL])
    return out.groupBy(LABEL).agg(*[F.avg(c).alias(c) for c in fitted.classes])


_OUTCOME = """CASE WHEN strikes = 2 AND coalesce(release_speed, 80.0) > 85 THEN 'swinging_strike' WHEN plate_z > 3.4 THEN 'ball'
  WHEN plate_x < -0.4 THEN 'foul' WHEN pitch_key % 9 = 0 THEN 'ball' ELSE 'called_strike' END"""
_SPLIT = (
    f"p AS ({PITCHES_FROM_ORDERS}), o AS (SELECT * REPLACE ({_OUTCOME} AS description) FROM p), "
    f"k AS ({ranked_sql(42, 'description', 'o', 'pitch_key')}), t AS (SELECT *, r < round(n * 0.2E0) AS is_test FROM k)"
)


@checked(f"WITH {_SPLIT} SELECT description, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM t WHERE is_test GROUP BY 1")
def saved_model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Test rows whose prediction changes when the fitted pipeline is written and read back."""
    df = _pitches(spark, d)
    train, test = sides(stratified_split(df, KEY, LABEL))
    fitted = models.fit(train, LABEL, Preparer(flows.hashed_blocks(GROUPS)), _forest())
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    fitted.save(path)
    before = fitted.predict(test).select(KEY, LABEL, F.col(models.PREDICTED).alias("before"))
    after = models.Fitted.load(path).predict(test).select(KEY, F.col(models.PREDICTED).alias("after"))
    both = before.join(after, KEY)
    return both.groupBy(LABEL).agg(F.count("*").alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"))


@checked()
def evaluation_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Every report of one prediction frame, as (report, class, other, value)."""
    df = _pitches(spark, d)
    train, test = sides(stratified_split(df, KEY, LABEL))
    fitted = models.fit(train, LABEL, Preparer(flows.counted_blocks(GROUPS)), _forest())
    got = evaluate.evaluation(fitted.predict(test), LABEL, models.PREDICTED, fitted.classes)
    none = F.lit(None).cast("string")

    def part(name, frame, a, b, value):
        return frame.select(
            F.lit(name).alias("report"), F.col(a).alias("class"), (none if b is None else F.col(b)).alias("other"),
            F.col(value).cast("double").alias("value"),
        )

    return (
        part("f1", got["classification_report"], "class", None, "f1")
        .unionByName(part("confusion", got["confusion_matrix"], "label", "prediction", "count"))
        .unionByName(part("errors", got["errors"], "true_label", "predicted_label", "count"))
        .unionByName(part("roc_auc", got["roc_auc"], "class", None, "auc"))
    )


@checked()
def cross_validated_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Five metrics on both sides of every fold of repeated cross validation."""
    blocks = Preparer(flows.counted_blocks(GROUPS))
    return select.cross_validate(_pitches(spark, d), KEY, LABEL, blocks, _forest(), folds=5, repeats=3)


@checked()
def search_table(spark: SparkSession, d: str) -> DataFrame:
    """Ten draws on a tenth of the training rows, the best refitted on all of them."""
    grid = {"trees": [100, 200, 300], "depth": [None, 10, 20, 30], "split": [2, 5, 10], "leaf": [1, 2, 4]}
    run = flows.searched_run(_pitches(spark, d), KEY, LABEL, flows.counted_blocks(GROUPS), grid, draws=10, folds=3, sample=0.1)
    return run.search


@checked()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    train, test = sides(stratified_split(_pitches(spark, d), KEY, LABEL))
    makers = {
        "random_forest": _forest(),
        "extra_trees": lambda _: models.extra_trees(),
        "logistic_regression": lambda rows: models.logistic_regression(rows.count()),
        "boosted_trees": lambda _: models.boosted_trees(),
    }
    return select.compare_models(train, test, LABEL, Preparer(flows.counted_blocks(GROUPS)), makers)


@checked()
def balance_comparison(spark: SparkSession, d: str) -> DataFrame:
    train, test = sides(stratified_split(_pitches(spark, d), KEY, LABEL))
    return select.compare_balancing(train, test, KEY, LABEL, Preparer(flows.counted_blocks(GROUPS)), _forest())


@checked()
def feature_set_comparison(spark: SparkSession, d: str) -> DataFrame:
    """With and without a leaking column, cross-validated."""
    df = _pitches(spark, d).withColumn("leak", F.length(LABEL))
    clean = flows.counted_blocks(GROUPS)
    sets = {"all": Preparer([*clean, Block("leak", ["leak"], "mean")]), "cleaned": Preparer(clean)}
    return select.compare_feature_sets(df, KEY, LABEL, sets, _forest())


@checked()
def importance_selection(spark: SparkSession, d: str) -> DataFrame:
    """Features of at least median importance."""
    df = _pitches(spark, d)
    train, _ = sides(stratified_split(df, KEY, LABEL))
    fitted = models.fit(train, LABEL, Preparer(flows.counted_blocks(GROUPS)), _forest())
    names = feature_names(fitted.predict(train.limit(0)))
    kept = select.select_by_importance(fitted.classifier)
    ranked = select.importances(fitted.classifier, names, spark)
    return ranked.filter(F.col("feature").isin([names[i] for i in kept]))


@checked()
def rfe_curve(spark: SparkSession, d: str) -> DataFrame:
    blocks = Preparer(flows.counted_blocks(GROUPS))
    return select.recursive_elimination(_pitches(spark, d), KEY, LABEL, blocks, _forest())[0]


@checked()
def screening_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sparse and id-like columns out, then every screen over what is left."""
    return flows.screening_run(_pitches(spark, d).drop(KEY), LABEL, missing=0.2)


# ---------------------------------------------------------------- neighbours and synthetic rows


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") % 3).alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )


_VECTORS = "SELECT vec_id, CAST(label % 3 AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
_RANKED_PAIRS = (
    "SELECT a.vec_id, a.label, a.x, b.vec_id AS neighbour, b.x AS y, list_distance(a.x, b.x) AS distance, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank "
    "FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id"
)


@checked(
    f"WITH v AS ({_VECTORS}), p AS ({_RANKED_PAIRS}) "
    "SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM p WHERE rank <= 5"
)
def nearest_in_class(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of the same class, exactly; rows with equal vectors are rows too."""
    out = nearest_rows(_vectors(spark, d), "vec_id", "label", "x", 5)
    return out.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("distance", 6).alias("distance"))


def _hash_sql(text: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5({text} || ':{seed}'), 1, 15) AS BIGINT)"


_PICK = "CAST(vec_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)"


@checked(f"""
WITH v AS ({_VECTORS}), p AS ({_RANKED_PAIRS}),
r AS ({ranked_sql(42, "label", "v", "vec_id")}),
c AS (SELECT label, max(n) AS n, max(max(n)) OVER () - max(n) AS need FROM r GROUP BY 1),
m AS (SELECT label, unnest(range(need)) AS d, n FROM c),
t AS (SELECT label, {_hash_sql("CAST(label AS VARCHAR) || ':' || CAST(d AS VARCHAR)", "42")} % n AS r, count(*) AS times FROM m GROUP BY 1, 2),
b AS (SELECT r.vec_id, r.label, r.x, unnest(range(1, t.times + 1)) AS copy FROM r JOIN t ON r.label = t.label AND r.r = t.r),
s AS (SELECT b.*, {_hash_sql(_PICK, "42:neighbour")} % 5 AS pick, {_hash_sql(_PICK, "42:step")} / 1152921504606846976.0E0 AS u FROM b)
SELECT vec_id, label, CAST(0 AS BIGINT) AS copy, round(x[1], 6) AS first, round(list_sum(x), 6) AS total FROM v
UNION ALL
SELECT s.vec_id, s.label, s.copy, round(s.x[1] + u * (p.y[1] - s.x[1]), 6), round(list_sum(s.x) + u * (list_sum(p.y) - list_sum(s.x)), 6)
FROM s JOIN p ON s.vec_id = p.vec_id AND p.rank = s.pick + 1""")
def smote_rows(spark: SparkSession, d: str) -> DataFrame:
    """Given rows and rows made between neighbours, every class at the size of the largest."""
    out = smote(_vectors(spark, d), "vec_id", "label", "x", k=5)
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return out.select(
        "vec_id", "label", "copy", F.round(F.col("x")[0], 6).alias("first"), F.round(total, 6).alias("total")
    )


# ---------------------------------------------------------------- one split, one round, one forward pass

_COUNTS = ["balls", "strikes", "inning", "home_score", "away_score", "age_pit", "age_bat"]
_FILLED = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _COUNTS)
_NARROW = f"""
p AS ({PITCHES_FROM_ORDERS}), o AS (SELECT * REPLACE ({_OUTCOME} AS description) FROM p),
r AS (SELECT pitch_key, description AS y, {_FILLED} FROM o),
v AS (
  {" UNION ALL ".join(f"SELECT pitch_key, y, {i} AS f, '{c}' AS feature, {c} AS x FROM r" for i, c in enumerate(_COUNTS))}),
c AS (SELECT f, feature, x, y, count(*) AS n FROM v GROUP BY ALL),
values_of AS (SELECT DISTINCT f, feature, x FROM c),
total AS (SELECT y, count(*) AS n FROM r GROUP BY 1),
cuts AS (SELECT f, feature, x AS low, lead(x) OVER (PARTITION BY f ORDER BY x) AS high FROM values_of),
sides AS (
  SELECT cuts.f, low, y, sum(CASE WHEN c.x <= low THEN n ELSE 0 END) AS l, sum(CASE WHEN c.x > low THEN n ELSE 0 END) AS r
  FROM cuts JOIN c ON cuts.f = c.f WHERE high IS NOT NULL GROUP BY 1, 2, 3),
gains AS (
  SELECT f, low, sum(l * l) / sum(l) + sum(r * r) / sum(r) - (SELECT sum(n * n) / sum(n) FROM total) AS gain
  FROM sides GROUP BY 1, 2)"""


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    """Seven counted columns, gaps as 0, as a vector beside the class number."""
    df = _pitches(spark, d).fillna(0, _COUNTS)
    ready = models.label_indexer(df, LABEL).transform(df)
    vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in _COUNTS]))
    return ready.select(KEY, LABEL, models.LABEL, vector.alias("features"))


def _stump_table(rows: DataFrame, fitted) -> DataFrame:
    """Each side of a one-split tree with its rows by class, as the fitted model predicts them."""
    tree = fitted.trees[0]
    feature, cut, gain = int(tree["feature"][0]), float(tree["threshold"][0]), float(tree["gain"][0])
    x = vector_to_array("features")[feature]
    sides = fitted.transform(rows).withColumn("below", x <= cut).withColumn("share", vector_to_array("probability")[F.col(models.LABEL).cast("int")])
    return sides.groupBy("below", F.col(LABEL).alias("class")).agg(F.count("*").alias("n"), F.round(F.max("share"), 6).alias("share")).select(
        F.lit(_COUNTS[feature]).alias("feature"), F.round(F.lit(cut), 6).alias("threshold"), F.round(F.lit(gain), 4).alias("gain"), "below", "class", "n", "share"
    )


def _stump_sql(pick: str) -> str:
    return f"""WITH {_NARROW}, {pick},
s AS (SELECT b.feature, b.threshold, b.gain, v.x <= b.threshold AS below, v.y AS class, count(*) AS n FROM v JOIN best b ON v.f = b.f GROUP BY ALL)
SELECT feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, below, class, n,
       round(n / CAST(sum(n) OVER (PARTITION BY below) AS DOUBLE), 6) AS share FROM s"""


@checked(_stump_sql("""best AS (
  SELECT cuts.f, feature, (cuts.low + high) / 2 AS threshold, gain FROM gains JOIN cuts ON gains.f = cuts.f AND gains.low = cuts.low
  ORDER BY gain DESC, cuts.f, cuts.low LIMIT 1)"""))
def forest_first_split(spark: SparkSession, d: str) -> DataFrame:
    """A tree of one split over all features: its Gini gain and what it predicts."""
    rows = _narrow(spark, d)
    return _stump_table(rows, Forest(trees=1, depth=1, bootstrap=False, tried=len(_COUNTS)).fit(rows))


def _drawn_numbers() -> list[float]:
    """What a tree's root draws for each feature, in [0, 1)."""
    key = np.repeat(node_key(42, 0), len(_COUNTS))
    return uniform(key, np.arange(len(_COUNTS))).tolist()


@checked(_stump_sql(f"""u(f, u) AS (VALUES {", ".join(f"({i}, {u!r}E0)" for i, u in enumerate(_drawn_numbers()))}),
drawn AS (SELECT u.f, min(x) + u * (max(x) - min(x)) AS t FROM u JOIN values_of o ON u.f = o.f GROUP BY u.f, u),
best AS (
  SELECT cuts.f, feature, cuts.low AS threshold, gain
  FROM gains JOIN cuts ON gains.f = cuts.f AND gains.low = cuts.low JOIN drawn ON drawn.f = cuts.f AND cuts.low <= t AND high > t
  ORDER BY gain DESC, cuts.f LIMIT 1)"""))
def extra_tree_first_split(spark: SparkSession, d: str) -> DataFrame:
    """The best of one drawn threshold per feature; the drawn shares of the ranges are fixed by the seed."""
    rows = _narrow(spark, d)
    return _stump_table(rows, Forest(trees=1, depth=1, bootstrap=False, drawn=True, tried=len(_COUNTS)).fit(rows))


@checked(f"""WITH {_NARROW},
k AS (SELECT y AS class, n / CAST(sum(n) OVER () AS DOUBLE) AS p, count(*) OVER () AS classes FROM total),
g AS (
  SELECT k.class, p, classes, sides.f, sides.low, sum(CASE WHEN y = k.class THEN l ELSE 0 END) - p * sum(l) AS gl,
         sum(CASE WHEN y = k.class THEN r ELSE 0 END) - p * sum(r) AS gr, sum(l) AS l, sum(r) AS r
  FROM sides CROSS JOIN k GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT *, (gl * gl / l + gr * gr / r - (gl + gr) * (gl + gr) / (l + r)) / (p * (1 - p)) AS gain FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY gain DESC, f, low) AS best FROM s)
SELECT class, feature, (b.low + high) / 2 AS threshold, round(ln(p), 6) AS start,
       round(0.1E0 * (classes - 1) / classes * gl / (l * p * (1 - p)), 6) AS below,
       round(0.1E0 * (classes - 1) / classes * gr / (r * p * (1 - p)), 6) AS above
FROM b JOIN cuts ON b.f = cuts.f AND b.low = cuts.low WHERE best = 1""")
def boosted_first_round(spark: SparkSession, d: str) -> DataFrame:
    """One split per class in the first round: starting scores and leaf values."""
    rows = _narrow(spark, d)
    fitted = Boosting(rounds=1, depth=1).fit(rows)
    classes = rows.schema[models.LABEL].metadata["ml_attr"]["vals"]
    out = []
    for name, start, tree in zip(classes, fitted.start, fitted.trees):
        value = tree["value"][:, 0].astype(float)
        out.append((name, _COUNTS[tree["feature"][0]], float(tree["threshold"][0]), round(start, 6), float(value[tree["left"][0]]), float(value[tree["right"][0]])))
    made = spark.createDataFrame(out, "class string, feature string, threshold double, start double, below double, above double")
    return made.withColumns({c: F.round(c, 6) for c in ("below", "above")})


def _fixed_network() -> NetworkModel:
    """Seven inputs, units of 5 and 4, three classes; weights by a rule that SQL states too."""
    layers = Layers((len(_COUNTS), 5, 4, 3))
    flat = np.zeros(layers.weights)
    for n, (w, b) in enumerate(layers.parts(flat)):
        i, j = np.indices(w.shape)
        w[:] = ((i * 7 + j * 3 + n) % 11 - 5) / 20.0
        b[:] = (np.arange(len(b)) + n) % 3 / 4.0
    return NetworkModel(layers.sizes, flat)


def _layer_sql(n: int, inputs: list[str], units: int, last: bool) -> list[str]:
    out = []
    for j in range(units):
        total = " + ".join(f"{x} * {((i * 7 + j * 3 + n) % 11 - 5) / 20.0}E0" for i, x in enumerate(inputs)) + f" + {(j + n) % 3 / 4.0}E0"
        out.append(f"{total} AS z{j}" if last else f"greatest({total}, 0) AS h{n}_{j}")
    return out


@checked(f"""WITH p AS ({PITCHES_FROM_ORDERS}), r AS (SELECT pitch_key, {_FILLED} FROM p),
a AS (SELECT pitch_key, {", ".join(_layer_sql(0, _COUNTS, 5, False))} FROM r),
b AS (SELECT pitch_key, {", ".join(_layer_sql(1, [f"h0_{i}" for i in range(5)], 4, False))} FROM a),
c AS (SELECT pitch_key, {", ".join(_layer_sql(2, [f"h1_{i}" for i in range(4)], 3, True))} FROM b)
SELECT pitch_key, round(z0, 6) AS z0, round(z1, 6) AS z1, round(z2, 6) AS z2,
       round(exp(z1) / (exp(z0) + exp(z1) + exp(z2)), 6) AS p1 FROM c""")
def network_forward(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a network of rectified units with fixed weights, for every row."""
    out = _fixed_network().transform(_narrow(spark, d))
    z = vector_to_array("rawPrediction")
    return out.select(KEY, *[F.round(z[i], 6).alias(f"z{i}") for i in range(3)], F.round(vector_to_array("probability")[1], 6).alias("p1"))
