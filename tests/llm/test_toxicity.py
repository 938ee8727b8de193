import random

import pytest

from tabloom.llm import toxicity

MILD, WORDS = ["vileling", "vilest", "grubword"], [a + b + c for a in "kmprst" for b in "aeiou" for c in ("n", "rl", "st", "m")]


def _text(rnd, bad):
    words = [rnd.choice(WORDS) for _ in range(rnd.randint(30, 90))]
    for _ in range(bad):
        words.insert(rnd.randrange(len(words)), rnd.choice(MILD) + rnd.choice(["", ",", "."]))
    return " ".join(words)


@pytest.fixture(scope="module")
def frames(spark):
    rnd = random.Random(8)
    bad = [rnd.choice([0, 0, 0, 1, 3, 8]) for _ in range(900)]
    docs = [(i, _text(rnd, b), "t") for i, b in enumerate(bad)]
    labels = [(i, int(b > 0)) for i, b in enumerate(bad) if i < 600]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, toxic string"),
        spark.createDataFrame([*labels, (None, 1), (5000, 1)], "doc_id bigint, toxic int"),
        bad,
    )


def test_held_out_accuracy_and_order(spark, frames):
    docs, labels, bad = frames
    model = toxicity.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) > 1
    held_out = [(r["doc_id"], r["severity"], r["toxic"]) for r in toxicity.scored(docs, model).collect() if r["doc_id"] >= 600]
    wrong = sum((bad[i] > 0) != t for i, _, t in held_out)
    assert wrong <= 0.03 * len(held_out)
    mean = lambda n: (lambda v: sum(v) / len(v))([s for i, s, _ in held_out if bad[i] == n])
    assert mean(0) < mean(1) < mean(3) < mean(8)


def test_same_on_every_run_and_formula(spark, frames):
    docs, labels, _ = frames
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert model.weights.keys() == again.weights.keys()
    assert max(abs(model.weights[k] - again.weights[k]) for k in model.weights) < 1e-6
    scorer = toxicity.Scorer(toxicity.Model({"ab": 2.0, "abc*": 1.0}, (1.0, 2.0)))
    sig = lambda x: 1 / (1 + 2.718281828459045 ** -x)
    assert scorer("AB, ab abcd") == pytest.approx(sig(2.0) + sig(1.0))
    assert scorer(None) == scorer("") == pytest.approx(sig(-1.0) + sig(-2.0))


def test_stage_keeps_columns_and_odd_rows(spark, frames):
    docs, labels, _ = frames
    odd = spark.createDataFrame([(None, None, None), (5000, "", "x"), (1, "vilest " * 9, "y"), (1, "vilest " * 9, "y")], docs.schema)
    both = docs.union(odd)
    kept = toxicity.without_toxic(both, labels)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert (None, None, None) in rows and (5000, "", "x") in rows and (1, "vilest " * 9, "y") not in rows
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_without_labels_nothing_is_toxic(spark, frames):
    docs, labels, _ = frames
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()
