"""The 113-column configuration and the end-to-end runs over synthetic pitches."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators import roles
from tabloom.plans import flows, models, pitches, select
from tabloom.operators.prepare import Preparer


def synthetic(spark, n=600):
    """Same names and types as the real table; deprecated columns empty, bases mostly empty."""
    levels = {"stand": 2, "p_throws": 2, "inning_topbot": 2, "pitch_type": 9, "home_team": 30, "away_team": 30}
    levels.update({"player_name": 90, "description": 4, "type": 3, "events": 12, "game_type": 1})

    def value(field):
        u = F.pmod(F.xxhash64("id", F.lit(field.name)), F.lit(1_000_003)) / 1_000_003.0
        name, kind = field.name, field.dataType
        if name in pitches.DEPRECATED and name != "des":
            return F.lit(None).cast(kind)
        if name == "description":
            return F.when(F.col("id") % 7 == 0, "foul").when(u < 0.4, "ball").otherwise("called_strike")
        if name == "at_bat_number":
            return (F.col("id") % 80).cast(kind)
        if name == "pitch_number":
            return (F.col("id") / 80).cast(kind)
        if name == "game_pk":
            return F.lit(7).cast(kind)
        if isinstance(kind, T.DateType):
            return F.date_add(F.lit("2024-03-28").cast("date"), (u * 180).cast("int"))
        if name == "des":
            return F.concat(F.lit("play "), F.col("id").cast("string"))
        if isinstance(kind, T.StringType):
            return F.concat(F.lit(name[:2]), (u * levels.get(name, 5)).cast("int").cast("string"))
        if isinstance(kind, T.LongType):
            filled = (u * 60).cast("long") + 600000
            return F.when(u < 0.3, filled) if name in pitches.BASES else filled
        if isinstance(kind, T.IntegerType):
            return (u * 12).cast("int")
        v = u * 10
        return F.when(u < 0.5, v) if name in ("bat_speed", "swing_length") else v

    fields = pitches.schema().fields
    return spark.range(n, numPartitions=4).select(*[value(f).alias(f.name) for f in fields]).withColumn("key", flows.pitch_key())


@pytest.fixture(scope="module")
def table(spark):
    df = synthetic(spark).cache()
    df.count()
    return df


def test_column_counts(table):
    df = table.drop("key")
    assert len(df.columns) == 113 == len(set(df.columns))
    assert len(roles.select_types(df, "number").columns) == 96
    assert len(roles.select_types(df, "text").columns) == 17
    split = {r["column"]: r["role"] for r in roles.cardinality_split(df).collect()}
    assert sorted(c for c, r in split.items() if r == "skipped") == ["des", "game_date", "player_name"]
    assert sum(r == "kept" for r in split.values()) == 14


def test_name_rules():
    names = pitches.columns()
    assert len([c for c in names if any(p in c for p in pitches.BY_NAME)]) == 13
    assert len(pitches.LEAKY) == 29 and len(pitches.DEPRECATED) == 11
    assert len(pitches.hashed_groups().included) == 25 + 18 + 10 + 13


def test_counted_groups(table):
    g = pitches.counted_groups(table.drop("key"))
    assert len(g.included) == 67 and not g.overlap() and not g.missing_from(table.columns)
    assert not set(pitches.BASES) & set(g.excluded)
    assert {"bat_speed", "umpire", "delta_run_exp", "des"} <= set(g.excluded)


def test_hashed_run(table):
    run = flows.forest_run(table, "key", pitches.TARGET, flows.hashed_blocks(pitches.hashed_groups()), trees=3, depth=3)
    report = {r["class"]: r for r in run.report.collect()}
    assert {"ball", "called_strike", "foul", "accuracy", "macro avg", "weighted avg"} == set(report)
    assert abs(report["accuracy"].support - 120) <= 1
    scores = run.importance.collect()
    assert abs(sum(r.importance for r in scores) - 1) < 1e-9
    assert {"Hash_hash_0", "release_speed", "stand_st0"} <= {r.feature for r in scores}


def test_robust_run_with_search(table):
    g = pitches.robust_groups()
    groups = replace(g, continuous=g.continuous[:3], discrete=g.discrete[:3], identifying=g.identifying[:2])
    grid = {"trees": [2, 3], "depth": [2, 3], "leaf": [1]}
    run = flows.searched_run(table, "key", pitches.TARGET, flows.robust_blocks(groups), grid, draws=2, folds=2)
    found = run.search.collect()
    assert sorted(r["rank"] for r in found) == [1, 2] and len({r.params for r in found}) == 2


def test_saved_model_predicts_alike(table, tmp_path):
    g = pitches.hashed_groups()
    small = replace(g, categorical=(), identifying=("batter",), id_flags=("on_1b",), discrete=("balls",), continuous=("ax",))
    keep = flows.counted_blocks(small)
    fitted = models.fit(table, pitches.TARGET, Preparer(keep), lambda _: models.random_forest(3, 3))
    fitted.save(str(tmp_path / "m"))
    again = models.Fitted.load(str(tmp_path / "m"))
    pick = lambda f: sorted(map(tuple, f.predict(table).select("key", models.PREDICTED).collect()))
    assert pick(fitted) == pick(again)
    assert again.classes == ["ball", "called_strike", "foul"]


def test_draws_are_distinct():
    grid = {"a": [1, 2, 3], "b": [1, 2]}
    assert len({str(d) for d in select.grid_draws(grid, 4)}) == 4
    assert len(select.grid_draws(grid, 99)) == 6


def test_strict_drop(table):
    with pytest.raises(ValueError):
        roles.drop_strict(table, ["no_such_column"])
