import random

import pytest

from oracle import differences, oracle_connection
from tabloom.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert differences(queries.registered()[name](spark, SF), oracle_connection(SF), queries.SQL[name]) == []


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, size string")


def _mixed(spark, docs):
    rows = mixing.measured(docs)
    return mixing.mix(rows, rows.select("source", "size", "hash")).collect()


def test_targets_near_and_limits(spark):
    rnd = random.Random(2)
    sizes = {"a": 400, "b": 40, "c": 400, "é": 5, None: 200}
    rows = [(i, s, "w " * rnd.randint(0, 60), "x") for s, n in sizes.items() for i in range(n)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = _mixed(spark, _docs(spark, rows))
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for s, v in by.items():
        assert {r["source_size"] for r in v} == {sum(r["size"] for r in v)}
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1e-6
    assert by["é"][0]["target"] == 3 * by["é"][0]["source_size"]


def test_empty_and_wordless(spark):
    assert _mixed(spark, _docs(spark, [])) == []
    got = _mixed(spark, _docs(spark, [(1, "a", None, None), (2, None, " \n", None)]))
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, "big" if i % 7 else "small", f"w{i} " * (1 + i % 5), None) for i in range(140)] + [(3, "big", "w3 " * 4, None)]
    docs = _docs(spark, rows)
    want = {}
    for r in _mixed(spark, docs):
        want[r["doc_id"]] = r["taken"] // r["size"] * (2 if r["doc_id"] == 3 else 1)
    got = {}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_thresholds_are_nested(spark):
    rows = mixing.measured(_docs(spark, [(i, "a", "w " * (i % 9 + 1), None) for i in range(300)]))
    small = spark.createDataFrame([("a", 1500, 400.0)], "source string, source_size bigint, target double")
    large = spark.createDataFrame([("a", 1500, 900.0)], "source string, source_size bigint, target double")
    low, high = (mixing.thresholds(rows, g).first() for g in (small, large))
    assert low["until"] < high["until"] and low["times"] == high["times"] == 0
