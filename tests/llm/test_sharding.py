import random
import zlib
from collections import Counter

import pytest

from tabloom.llm import queries, sharding


def _laws(rows, n, shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == n
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts.get(s, 0)))


def _pieces(rows):
    """Shards over which each linked text is spread."""
    where, n = {}, Counter(r["text"] for r in rows)
    for r in rows:
        where.setdefault(r["text"], set()).add(r["shard"])
    return {t: len(where[t]) for t in where if n[t] > 1}


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, shard string, unit int")


def test_small_groups_stay_together(spark):
    rnd = random.Random(1)
    texts = [f"only {i}" for i in range(300)] + [f"pair {i // 3}" for i in range(240)]
    rnd.shuffle(texts)
    rows = sharding.shard_documents(_documents(spark, texts), 8).collect()
    _laws(rows, 540, 8)
    assert set(_pieces(rows).values()) == {1}


def test_all_linked(spark):
    texts = [f"pair {i // 2}" for i in range(640)]
    rows = sharding.shard_documents(_documents(spark, texts), 8).collect()
    _laws(rows, 640, 8)
    assert sum(v > 1 for v in _pieces(rows).values()) <= 32  # of 320


def test_group_larger_than_a_shard_fills_few(spark):
    texts = ["hot"] * 2000 + [f"only {i}" for i in range(3000)] + [f"p{i // 2}" for i in range(1000)]
    rows = sharding.shard_documents(_documents(spark, texts), 16).collect()
    _laws(rows, 6000, 16)
    pieces = _pieces(rows)
    assert 6 <= pieces.pop("hot") <= 8  # 5.33 quotas
    assert sum(v > 1 for v in pieces.values()) <= 25


@pytest.mark.parametrize("n", [0, 1, 5, 17])
def test_few_rows(spark, n):
    df = _documents(spark, [None, "", "a", "a", None] * 4).limit(n)
    rows = sharding.shard_documents(df, 16).collect()
    assert len(rows) == n
    if n:
        _laws(rows, n, 16)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "t")] * 40 + [(1, "u")] * 20 + [(None, None)] * 3, "doc_id bigint, text string")
    rows = sharding.shard_documents(df, 4).collect()
    _laws(rows, 63, 4)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter([(None, "t")] * 40 + [(1, "u")] * 20 + [(None, None)] * 3)


def test_query_against_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_sharding(spark, sf).collect()
    _laws(rows, len(docs), 16)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op9_sharding(spark, sf).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
