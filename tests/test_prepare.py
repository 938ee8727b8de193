import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import learned
from tabloom.operators.prepare import (
    Block,
    FrequencyEncoding,
    Imputing,
    OneHotEncoding,
    OrdinalEncoding,
    Preparer,
    Scaling,
    explain_prepare,
    feature_names,
)


def fitted(estimator, fit_df, df=None, out="o"):
    return [r[0] for r in estimator.fit(fit_df).transform(df if df is not None else fit_df).select(out).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize("values, tie", [(("b", "b", "a", "a", None), "a"), (("10", "9", "10", "9", None), "10")])
def test_mode_tie_is_smallest_text(spark, values, tie):
    got = fitted(Imputing(inputCols=["x"], outputCols=["o"], strategy="most_frequent"), texts(spark, *values))
    assert got[-1] == tie


def test_mode_tie_is_smallest_number(spark):
    got = fitted(
        Imputing(inputCols=["x"], outputCols=["o"], strategy="most_frequent"), numbers(spark, 10.0, 9.0, 10.0, 9.0, None)
    )
    assert got[-1] == 9.0


def test_median_and_mean(spark):
    df = numbers(spark, 1.0, 2.0, 4.0, 10.0, None)
    assert fitted(Imputing(inputCols=["x"], outputCols=["o"], strategy="median"), df)[-1] == 3.0
    assert fitted(Imputing(inputCols=["x"], outputCols=["o"], strategy="mean"), df)[-1] == 4.25


def test_all_missing_column_stays_missing(spark):
    df = numbers(spark, None, None)
    for strategy in ("mean", "median", "most_frequent"):
        assert fitted(Imputing(inputCols=["x"], outputCols=["o"], strategy=strategy), df) == [None, None]


def test_scaling(spark):
    df = numbers(spark, 1.0, 2.0, 4.0, None)
    got = fitted(Scaling(inputCols=["x"], outputCols=["o"]), df)
    assert [v and round(v, 6) for v in got] == [-1.069045, -0.267261, 1.336306, None]
    got = fitted(Scaling(inputCols=["x"], outputCols=["o"], kind="robust"), numbers(spark, 1.0, 2.0, 4.0))
    assert [round(v, 6) for v in got] == [-0.666667, 0.0, 1.333333]
    constant = numbers(spark, 5.0, 5.0, 5.0)
    for kind in ("standard", "robust"):
        assert fitted(Scaling(inputCols=["x"], outputCols=["o"], kind=kind), constant) == [0.0, 0.0, 0.0]


def test_frequency(spark):
    fit_on, use_on = texts(spark, "x", "x", "y", None), texts(spark, "x", "z", None)
    assert fitted(FrequencyEncoding(inputCols=["x"], outputCols=["o"]), fit_on, use_on) == [2.0, 0.0, 0.0]
    shares = FrequencyEncoding(inputCols=["x"], outputCols=["o"], share=True, minShare=0.3)
    # a missing value counts as the text nan; y and nan are below the limit
    assert fitted(shares, fit_on, use_on) == [0.5, 0.0, 0.0]


def test_large_lookup_spreads_hot_values(spark, monkeypatch):
    rows = [("hot",)] * 3000 + [(f"v{i % 700}",) for i in range(1400)] + [(None,)] * 500
    df = spark.createDataFrame(rows, "x string")
    small = FrequencyEncoding(inputCols=["x"], outputCols=["o"]).fit(df).transform(df)
    monkeypatch.setattr(learned, "is_small", lambda *_: False)
    model = FrequencyEncoding(inputCols=["x"], outputCols=["o"]).fit(df)
    assert model.getOrDefault(model.broadcastTable) is False
    large = model.transform(df)
    count = lambda d: sorted((str(r[0]), r[1], r[2]) for r in d.groupBy("x", "o").count().collect())
    assert count(small) == count(large)


def test_one_hot(spark):
    fit_on, use_on = texts(spark, "a", "b"), texts(spark, "a", "zz", None)
    model = OneHotEncoding(inputCols=["x"], outputCols=["o"]).fit(fit_on)
    got = [list(r[0]) for r in model.transform(use_on).select(vector_to_array("o")).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_columns_of_different_width(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), (None, None)], "p string, q string")
    enc = OrdinalEncoding(inputCols=["p", "q"], outputCols=["po", "qo"])
    got = [tuple(r) for r in enc.fit(df).transform(df).select("po", "qo").collect()]
    assert got == [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (-1.0, -1.0)]
    hot = OneHotEncoding(inputCols=["p", "q"], outputCols=["po", "qo"]).fit(df).transform(df)
    sizes = hot.select(F.size(vector_to_array("po")), F.size(vector_to_array("qo"))).distinct().collect()
    assert [tuple(r) for r in sizes] == [(3, 2)]


BLOCKS = [
    Block("num", ["n"], "mean", scale="standard"),
    Block("cat", ["c"], "most_frequent", encode="onehot"),
    Block("bin", ["two"], "constant", fill="missing", encode="onehot", drop_binary=True),
    Block("Hash", ["i", "j"], encode="hash", buckets=4),
    Block("id", ["i"], encode="frequency"),
    Block("there", ["j"], encode="presence"),
]


def frame(spark):
    return spark.createDataFrame(
        [(1.0, "r", "L", 1, None), (2.0, "s", "R", 1, 7), (None, None, "L", 2, 8), (3.0, "r", "R", 3, None)],
        "n double, c string, two string, i long, j long",
    )


def test_preparer_vector_and_names(spark):
    df = frame(spark)
    out = Preparer(BLOCKS).fit(df).transform(df)
    names = feature_names(out)
    rows = [list(r[0]) for r in out.select(vector_to_array("features")).collect()]
    assert all(len(r) == len(names) for r in rows)
    assert names == ["n", "c_r", "c_s", "two", "Hash_hash_0", "Hash_hash_1", "Hash_hash_2", "Hash_hash_3", "i", "j"]
    at = {n: i for i, n in enumerate(names)}
    assert [r[at["i"]] for r in rows] == [2.0, 2.0, 1.0, 1.0]
    assert [r[at["j"]] for r in rows] == [0.0, 1.0, 1.0, 0.0]
    assert [r[at["c_r"]] for r in rows] == [1.0, 0.0, 1.0, 1.0]
    assert all(sum(r[4:8]) == 2.0 for r in rows)
    assert rows[2][0] == 0.0


def test_preparer_saves_and_trims(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = frame(spark)
    model = Preparer(BLOCKS).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    vectors = lambda m: [r[0] for r in m.transform(df).select("features").collect()]
    assert vectors(model) == vectors(again)
    fewer = Preparer(BLOCKS).trimmed(["n", "c"])
    assert feature_names(fewer.fit(df).transform(df)) == ["n", "c_r", "c_s"]


def test_diagnosis_names_the_failing_block(spark):
    got = explain_prepare(Preparer([Block("ok", ["n"], "mean"), Block("bad", ["nope"], "mean")]), frame(spark)).collect()
    assert {r.block for r in got if r.error} == {"bad"}
    assert {r.rows for r in got if r.block == "ok"} == {4}


def test_columns_wider_than_a_list_of_labels(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    from tabloom.operators import prepare

    rows = [(i, (i * 7) % 40, f"v{(i * 3) % 25:02d}") for i in range(200)] + [(200, None, None)]
    df = spark.createDataFrame(rows, "k int, n bigint, t string")
    unseen = df.union(spark.createDataFrame([(201, 999, "zz")], df.schema))
    blocks = [Block("o", ["n", "t"], encode="ordinal"), Block("h", ["n", "t"], encode="onehot")]

    def run():
        by_block = []
        for b in blocks:
            out = Preparer([b]).fit(df).transform(unseen)
            by_block.append(sorted((r.k, r.v) for r in out.select("k", vector_to_array("features").alias("v")).collect()))
        return by_block

    listed = run()
    monkeypatch.setattr(prepare, "MAX_LABELS", 10)
    assert run() == listed
    assert listed[0][200][1] == [-1.0, -1.0] and listed[0][201][1] == [-1.0, -1.0]
    assert sum(listed[1][201][1]) == 0 and sum(listed[1][0][1]) == 2
