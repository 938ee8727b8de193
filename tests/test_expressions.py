from pyspark.sql import functions as F

from tabloom.functions import expressions as ex
from tabloom.functions.hashing import md5_bucket
from tabloom.operators.features import PitchFeatures


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_right_closed_cut(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (4.0,), (6.0,), (7.0,), (None,)], "x double")
    band = ex.cut("x", [0, 3, 6, ex.INF], ["early", "middle", "late"])
    assert column(df, band) == [None, "early", "early", "middle", "middle", "late", None]
    rest = spark.createDataFrame([(-1,), (0,), (3,), (4,), (5,), (6,)], "x int")
    band = ex.cut("x", [-1, 3, 5, ex.INF], ["short_rest", "normal_rest", "extended_rest"])
    assert column(rest, band) == [None, "short_rest", "short_rest", "normal_rest", "normal_rest", "extended_rest"]


def test_pitch_features(spark):
    df = spark.createDataFrame(
        [
            (3, 2, 5, None, 7, 2200.0, 95.0, 3.0, 4.0, 0.3, 2.9, 3.5, 1.5),
            (None, 0, None, None, None, 2200.0, None, 3.0, 4.0, 0.3, 2.9, 3.5, 1.5),
        ],
        "balls int, strikes int, on_1b long, on_2b long, on_3b long, release_spin_rate double, release_speed double,"
        "pfx_x double, pfx_z double, plate_x double, plate_z double, sz_top double, sz_bot double",
    )
    a, b = PitchFeatures().transform(df).collect()
    assert a.baserunners_count == 2 and b.baserunners_count == 0
    assert round(a.count_leverage, 6) == 1.333333 and b.count_leverage is None
    assert a.count_state == "3-2" and b.count_state == "nan-0"
    assert round(a.speed_spin_ratio, 6) == 23.133544 and b.speed_spin_ratio is None
    assert a.break_magnitude == 5.0
    assert a.sz_center == 2.5 and round(a.pitch_location_from_center, 9) == 0.5
    # inputs that are not there make no feature
    assert "score_diff" not in a.asDict() and "inning_phase" not in a.asDict()


def test_casts(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,)], "x string")
    assert column(df, ex.to_number("x")) == [1.5, None, None]
    assert column(df, ex.text_or("x")) == ["1.5", "abc", "nan"]
    assert column(df, ex.present("x")) == [1, 1, 0]


def test_md5_bucket(spark):
    assert column(spark.range(1), md5_bucket(F.lit("660271"), 32)) == [3]
