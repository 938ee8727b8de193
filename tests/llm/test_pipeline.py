"""Each stage, over its own input, against a brute-force version of what it keeps."""

from collections import Counter

import pytest

import corpus_pipeline
from tabloom.llm import decontamination, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        out.append(docs.collect())
    return out


def test_names_and_columns(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "decontamination", "mixing", "sharding"]
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    for rows in steps[1:-1]:
        assert list(rows[0].asDict()) == want
    assert list(steps[-1][0].asDict()) == [*want, "shard", "slot"]


def test_toxicity(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in steps[1]} == {r.doc_id for r in steps[0] if scorer(r.text) < toxicity.TOXIC_FROM}
    assert len(steps[1]) < len(steps[0])


def test_one_of_each_group(steps):
    prints = [(r.doc_id, simhash.fingerprint_of(r.text) & (2**64 - 1)) for r in steps[1]]
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r.doc_id for r in steps[2]) == sorted(d for d in root if root[d] == d)


def test_leaks(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontamination.build(items)
    assert {r.doc_id for r in steps[3]} == {r.doc_id for r in steps[2] if not decontamination.leaks(r.text, index)}
    plain = [" ".join(decontamination.tokens_of(t)) for _, t in items]
    assert not [r.doc_id for r in steps[3] if any(p in " ".join(decontamination.tokens_of(r.text)) for p in plain)]


def test_mix_and_shards(steps):
    times = Counter(r.doc_id for r in steps[4])
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in steps[3]}
    assert Counter(tuple(r)[:-2] for r in steps[5]) == Counter(map(tuple, steps[4]))
    shards = Counter(r.shard for r in steps[5])
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 16


def test_run_gives_the_same(spark, steps):
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in steps[5])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_and_empty_tables(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [*docs.columns, "shard", "slot"] if name == "sharding" else docs.columns
    nothing = stage(spark, docs.limit(0), SF)
    assert nothing.columns == kept and nothing.count() == 0
    some = docs.limit(30).collect()
    odd = [(None, None, "en", None, 0), (None, "", None, "src1", 0), (7, None, None, None, None), (7, None, None, None, None), (8, "ein Wort", "de", "src1", 8)]
    rows = [tuple(r) for r in some] + odd + [tuple(some[0])] * 3
    out = stage(spark, spark.createDataFrame(rows, docs.schema), SF)
    got = Counter(tuple(r)[: len(docs.columns)] for r in out.collect())
    assert out.columns == kept and set(got) <= set(rows)
    if name in ("decontamination", "sharding"):  # nothing without a text is held back, and repeats stay
        assert all(got[r] == rows.count(r) for r in odd) and got[tuple(some[0])] in (0, rows.count(tuple(some[0])))
    if name == "simhash near-dedup":
        assert max(got.values()) == 1
