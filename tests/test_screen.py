import math

from tabloom.operators import screen


def table(spark, counts):
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(counts) for j, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "f string, y string")


def test_chi_square(spark):
    got = screen.with_chi2_p(screen.chi_square(table(spark, [[10, 20, 30], [20, 20, 20]]), ["f"], "y")).first()
    assert (round(got.chi2, 6), got.dof, round(got.p_value, 6)) == (5.333333, 2, 0.069483)
    two = screen.chi_square(table(spark, [[10, 20], [20, 10]]), ["f"], "y").first()
    assert round(two.chi2, 6) == 5.4
    # a cell under five, or an empty one, leaves the feature out
    assert screen.chi_square(table(spark, [[10, 20, 4], [20, 20, 20]]), ["f"], "y").count() == 0
    assert screen.chi_square(table(spark, [[10, 20, 0], [20, 20, 20]]), ["f"], "y").count() == 0


def test_chi_square_tail_odd_dof(spark):
    df = spark.createDataFrame([("a", 3.841458820694124, 1), ("b", 7.814727903251179, 3), ("c", 0.0, 2)], "f string, chi2 double, dof int")
    assert [round(r.p_value, 9) for r in screen.with_chi2_p(df).collect()] == [0.05, 0.05, 1.0]


def test_anova(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0), (2.0, 1), (4.0, 1), (6.0, 1)], "x double, y int")
    got = screen.with_f_p(screen.anova(df, ["x"], "y")).first()
    assert round(got.f, 9) == 2.4
    # F with 1 and 4 degrees: two-sided t tail with 4 degrees at sqrt(2.4)
    t = math.sqrt(2.4)
    x = t / math.sqrt(4 + t * t)
    assert abs(got.p_value - (1 - 1.5 * (x - x**3 / 3) )) < 1e-9


def test_f_tail_many_rows(spark):
    # with many rows k F is chi-square: 5% point for 2 degrees
    df = spark.createDataFrame([("a", 5.991464547107979 / 2, 2, 10**11)], "feature string, f double, between_dof int, within_dof long")
    assert abs(screen.with_f_p(df).first().p_value - 0.05) < 1e-6


def test_information(spark):
    df = spark.createDataFrame([("a", "a", "u"), ("b", "b", "u"), ("a", "a", "v"), ("b", "b", "v")], "f string, y string, g string")
    got = {r.feature: round(r.score, 6) for r in screen.discrete_information(df, ["f", "g"], "y").collect()}
    assert got == {"f": 0.693147, "g": 0.0}


def test_correlation_with_gaps(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, None, 5.0, None), (3.0, 5.0, 5.0, 1.0), (4.0, 4.0, 5.0, None), (None, 9.0, 5.0, None)],
        "x double, y double, k double, once double",
    )
    got = {(r.a, r.b): (r.n, r.corr and round(r.corr, 6)) for r in screen.correlations(df, ["x", "y", "k", "once"]).collect()}
    assert got[("x", "y")] == (3, 0.785714)
    assert got[("x", "k")] == (4, None)
    assert got[("x", "once")] == (1, None)
    assert len(got) == 6


def test_drop_correlated(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7), "t") for i in range(30)], "a double, b double, c double, t string")
    reduced, dropped = screen.drop_correlated(df, ["a", "b", "c"])
    assert dropped == ["b"] and reduced.columns == ["a", "c", "t"]


def test_a_batch_of_packed_cells_is_small():
    # a Python worker takes a hundred rows at a time: value, class and count of every point
    from tabloom.operators import information

    assert 100 * information.POINTS_PER_CELL * (8 + 4 + 8) <= 64 * 1024 * 1024
