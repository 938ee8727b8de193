"""Columns told apart by a sketch, and those that must still be counted."""

import random

from tabloom.operators import profile, roles


def test_no_column_within_the_limit_is_left_out(spark):
    rnd = random.Random(5)
    for most in (2, 30, 100, 900):
        counts = [1, most // 2 + 1, most - 1, most, most + 1, 3 * most + 20, 3000]
        pools = [[rnd.randrange(10**9) for _ in range(n)] for n in counts]
        rows = [tuple(p[i % len(p)] for p in pools) for i in range(3000)]
        df = spark.createDataFrame(rows, ", ".join(f"c{i} bigint" for i in range(len(counts))))
        few = profile.few_valued(df, df.columns, most)
        sure = [c for c, p in zip(df.columns, pools) if len(set(p)) <= most]
        assert set(sure) <= set(few) and "c6" not in few
        assert profile.few_valued(df, df.columns, 10**6) == df.columns


def test_odd_columns(spark):
    rows = [(float(i % 2) * 0.0 - (0.0 if i % 3 else 0.0), None, [i], f"v{i}", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "z double, n string, a array<int>, wide string, one string")
    assert profile.few_valued(df, df.columns, 10) == ["z", "n", "a", "one"]
    got = {r["column"]: r["role"] for r in roles.split_roles(df.drop("a"), cardinality=10).collect()}
    assert got == {"z": "numerical", "n": "categorical", "wide": "dropped", "one": "categorical"}
    assert roles.drop_ids(df.drop("a")).columns == ["z", "n", "one"]
    empty = df.drop("a").limit(0)
    assert roles.drop_ids(empty).columns == empty.columns
    assert profile.low_cardinality_values(df, ["wide"], most=10).count() == 0


def test_roles_without_counts_count_few_cells(spark, monkeypatch):
    rows = [(i, i % 15, i % 16, float(i), i % 7 if i % 5 else None, i if i % 5 > 1 else None, f"v{i}", True) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, few int, more int, x double, gaps int, sparse int, t string, flag boolean")
    whole = {r["column"]: (r["type"], r["role"], r["missing_share"]) for r in roles.column_roles(df, exclude_substrings=["fl"]).collect()}
    asked = []
    monkeypatch.setattr(roles, "column_profile", lambda d, columns=None: asked.append(columns) or profile.column_profile(d, columns))
    got = roles.column_roles(df, exclude_substrings=["fl"], counts=False)
    assert {r["column"]: (r["type"], r["role"], r["missing_share"]) for r in got.collect()} == whole
    assert whole["few"][1] == "discrete" and whole["more"][1] == "continuous" and whole["flag"][1] == "excluded_by_name"
    assert asked and not {"id", "x", "t", "sparse", "flag"} & set(asked[0])  # wide, excluded and text columns are not counted
    assert roles.column_roles(df.limit(0), counts=False).count() == roles.column_roles(df.limit(0)).count() == 0
