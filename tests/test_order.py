"""Ranks, running totals, quantiles: the cell paths against plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import quantiles, sample
from tabloom.operators.information import neighbour_information, with_neighbours
from tabloom.operators.ranks import cell_splits, running_sums


def hot_rows(n=900, seed=1):
    """A third of the rows in one group, values of very uneven density."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        g = "hot" if r.random() < 0.4 else r.choice("abc")
        out.add((g, round(r.gauss(0, 1) ** 3, 3)))
    return sorted(out)


def test_running_sums_in_cells(spark):
    df = spark.createDataFrame(hot_rows(), "g string, x double").withColumn("k", F.lit(2))
    splits = cell_splits(df, "x", 900, rows_per_cell=20)
    assert len(splits) > 20
    for down in (False, True):
        order = [F.desc("x") if down else F.col("x")]
        cells = running_sums(df, ["g"], order, "x", {"s": F.col("k")}, splits, descending=down)
        plain = running_sums(df, ["g"], order, "x", {"s": F.col("k")}, None)
        assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, plain.collect()))


def test_neighbours_reach_over_thin_cells(spark):
    rows = [(g, x, 1) for g, x in hot_rows()] + [("thin", float(x), 1) for x in (-9, 0, 9)]
    df = spark.createDataFrame(rows, "g string, x double, c int")
    cells = with_neighbours(df, ["g"], "x", "c", 3, cell_splits(df, "x", 903, rows_per_cell=10))
    plain = with_neighbours(df, ["g"], "x", "c", 3, None)
    names = sorted(plain.columns)
    pick = lambda d: sorted(map(str, d.select(*[F.col(f"`{n}`") for n in names]).collect()))
    assert pick(cells) == pick(plain)


def brute_information(rows, k=3):
    import numpy as np

    def psi(n):
        return sum(1.0 / i for i in range(1, int(n))) - 0.5772156649015329

    sizes = {}
    for _, g in rows:
        sizes[g] = sizes.get(g, 0) + 1
    rows = [(x, g) for x, g in rows if sizes[g] > 1]
    xs = np.array([x for x, _ in rows])
    total = 0.0
    for i, (x, g) in enumerate(rows):
        same = sorted(abs(x - y) for j, (y, h) in enumerate(rows) if h == g and j != i)
        kk = min(k, sizes[g] - 1)
        d = same[kk - 1]
        m = (np.abs(xs - x) < d - 2e-15 * (abs(x) + d)).sum() if d > 0 else (xs == x).sum()
        total += psi(kk) - psi(sizes[g]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("per_cell", [25, 10_000])
def test_neighbour_information(spark, per_cell):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        g = r.choice(["a", "a", "b", "c"])
        x = r.gauss({"a": 0, "b": 1, "c": 5}[g], 1)
        rows.append((round(x, 1) if r.random() < 0.4 else x, g))
    rows += [(2.0, "few"), (2.5, "few"), (9.0, "single")]
    df = spark.createDataFrame(rows, "x double, g string")
    got = neighbour_information(df, ["x"], "g", rows_per_cell=per_cell).collect()
    assert got[0].feature == "x"
    assert abs(got[0].score - brute_information(rows)) < 1e-9


@pytest.mark.parametrize("parts", [4096, 8])
def test_exact_quantiles(spark, monkeypatch, parts):
    import numpy as np

    monkeypatch.setattr(quantiles, "_PARTS", parts)
    r = random.Random(5)
    rows = [("hot" if i % 3 else "cold", r.choice([1.0, 2.0, r.gauss(0, 9)])) for i in range(3000)]
    rows += [("few", 1.0), ("few", 2.0), ("few", 3.0), ("few", 4.0), ("few", 100.0), ("few", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(t.g, t.prob): t.value for t in quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], ["g"]).collect()}
    for g in ("hot", "cold", "few"):
        values = [x for h, x in rows if h == g and x is not None]
        for p in (0.25, 0.5, 0.75):
            assert abs(got[(g, p)] - np.quantile(values, p)) < 1e-12
    assert quantiles.exact_quantiles(df.filter("g = 'none'"), ["x"], [0.5]).count() == 0


def test_quantiles_of_extreme_values(spark):
    import numpy as np

    near = [1.0 + i * 2.0**-52 for i in range(40)]  # neighbouring doubles
    rows = [("near", x) for x in near] + [("wide", s * 10.0**e) for e in range(-320, 308, 7) for s in (-1, 1)]
    rows += [("signs", x) for x in (-0.0, 0.0, -5e-324, 5e-324, -1.0)]
    rows += [("ends", x) for x in (float("-inf"), 1.0, float("inf"), float("inf"), float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(t.g, t.prob): t.value for t in quantiles.exact_quantiles(df, ["x"], [0.0, 0.3, 0.5, 1.0], ["g"]).collect()}
    for g in ("near", "wide", "signs"):
        values = sorted(x for h, x in rows if h == g)
        for p in (0.0, 0.3, 0.5, 1.0):
            at = p * (len(values) - 1)
            a, b = values[int(np.floor(at))], values[int(np.ceil(at))]
            assert got[(g, p)] == a + (b - a) * (at - np.floor(at))
    assert [got[("ends", p)] for p in (0.0, 0.5, 1.0)] == [float("-inf"), float("inf"), float("inf")]


def test_quantiles_where_no_value_is(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", float("nan"), None), (None, 1.0, 1.0)], "g string, x double, y double")
    got = {(t.g, t.column): (t.n, str(t.value)) for t in quantiles.exact_quantiles(df, ["x", "y"], [0.5], ["g"]).collect()}
    assert got == {("b", "x"): (1, "nan"), ("a", "y"): (1, "1.0")}


def labelled(spark, parts=4):
    return spark.range(1000, numPartitions=parts).select(
        "id", F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "tiny").otherwise("mid").alias("y")
    )


def test_split_sizes_and_partition_independence(spark):
    a = sample.stratified_split(labelled(spark, 1), "id", "y")
    b = sample.stratified_split(labelled(spark, 8), "id", "y")
    pick = lambda d: {r.id for r in d.filter("is_test").collect()}
    assert pick(a) == pick(b)
    sizes = {r.y: (r.n, r.t) for r in a.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(abs(t - 0.2 * n) <= 0.5 for n, t in sizes.values())
    assert sample.random_split(labelled(spark), "id").filter("is_test").count() == 200
    assert sample.fraction_sample(labelled(spark), "id", 0.1).count() == 100


def test_folds_are_even(spark):
    out = sample.stratified_folds(labelled(spark), "id", "y", 5)
    for r in out.groupBy("y").pivot("fold").count().collect():
        sizes = [r[str(i)] or 0 for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_balancing_sizes(spark):
    df = spark.createDataFrame([(i, "a") for i in range(7)] + [(10, "b"), (11, "b"), (12, "c")], "id long, y string")
    over = sample.oversample(df, "id", "y")
    assert {r["count"] for r in over.groupBy("y").count().collect()} == {7}
    assert over.filter("copy = 0").count() == 10
    under = sample.undersample(df, "id", "y")
    assert {r["count"] for r in under.groupBy("y").count().collect()} == {1}
    weights = {r.y: round(r.weight, 6) for r in sample.class_weights(df.filter("y != 'c'").filter("id < 3 or id = 10"), "y").collect()}
    assert weights == {"a": 0.666667, "b": 2.0}


def test_repeats_of_one_row_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(sample, "_REPEAT_CHUNK", 10)
    df = spark.createDataFrame([(1, 35), (2, 1)], "id long, t long")
    out = sample.repeat_rows(df, "t", "copy", "id")
    assert sorted(r.copy for r in out.filter("id = 1").collect()) == list(range(1, 36))
    assert [r.copy for r in out.filter("id = 2").collect()] == [1]


def test_shuffle_lookup_with_a_third_of_keys_missing(spark):
    from tabloom.operators.lookup import lookup

    df = spark.range(300).selectExpr("id", "CASE WHEN id % 3 <> 0 THEN id % 7 END AS k")
    table = spark.createDataFrame([(i, i * 10) for i in range(5)], "k bigint, stat bigint")
    got = {r["id"]: r["stat"] for r in lookup(df, table, ["k"], small=False).collect()}
    assert got == {i: (i % 7 * 10 if i % 3 and i % 7 < 5 else None) for i in range(300)}
    plan = lookup(df, table, ["k"], small=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull" in plan.lower()


def test_draws_use_no_nested_loop(spark):
    from tabloom.operators.sample import drawn_rows

    df = spark.range(60).selectExpr("id", "IF(id < 50, 'a', 'b') AS label")
    out = drawn_rows(df, "id", "label")
    assert sum(r["__times"] for r in out.collect()) == 40
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
