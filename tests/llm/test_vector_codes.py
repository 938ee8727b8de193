import hashlib
import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from tabloom.llm import vector_codes as vc
from tabloom.session import ensure_checkpoint_dir

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _brute(rows, entries=256, rounds=4):
    """Plain loops over exact Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in first] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(cut(r[1], p), e), k) for k, e in enumerate(books[p])) for p in range(4)] for r in kept]

    for _ in range(rounds):
        got = assign()
        for p in range(4):
            members = defaultdict(list)
            for r, a in zip(kept, got):
                members[a[p][1]].append(cut(r[1], p))
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    got = assign()
    error = [sum(d for d, _ in a) for a in got]
    by_label = defaultdict(int)
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    out = [(r[0], [k for _, k in a], e, by_label[r[2]]) for r, a, e in zip(kept, got, error)]
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(out, key=repr), hashlib.sha256(numbers.encode()).hexdigest()


def _got(df):
    coded, books = vc.compress(df)
    return sorted(((r.vec_id, list(r.code), r.error, r.label_error) for r in coded.collect()), key=repr), books.digest()


def _case(n, dims=8, spread=1.0):
    rnd = random.Random(n)
    as_float = lambda x: float(np.float32(x))
    rows = [(i, [as_float(rnd.gauss(0, spread)) for _ in range(dims)], rnd.choice([0, 1, None])) for i in range(n)]
    rows += [(rnd.randrange(n), list(rnd.choice(rows)[1]), 5) for _ in range(n // 3)]  # repeated vectors and ids
    rows += rows[:3]
    rows += [(7, None, 1), (8, [None] + [0.5] * (dims - 1), 1), (9, [float("nan")] * dims, 1), (None, [0.25] * dims, None),
             (11, [float("inf")] + [0.0] * (dims - 1), 2), (None, [float("-inf")] * dims, 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,spread", [(40, 1.0), (700, 0.02), (900, 1.0)])
def test_against_brute_force(spark, n, spread):
    rows = _case(n, spread=spread)  # a small spread makes many ties
    assert _got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == _brute(rows)


def test_balls_equal_full_comparison():
    rnd = np.random.default_rng(4)
    for dims, spread in ((1, 30), (2, 40), (4, 6), (16, 300)):
        x = rnd.integers(-spread, spread, (3000, dims))
        entries = x[rnd.choice(3000, 200, replace=False)].copy()
        before, _ = vc.nearest(x, entries)
        entries += rnd.integers(-2, 3, entries.shape)
        entries[5] = entries[9]  # two entries at one place
        code, d = vc.moved(x, entries, vc.squared_distances(entries, entries), before)
        want, least = vc.nearest(x, entries)
        assert (code == want).all() and (d == least).all()


def test_large_components_and_refusals(spark):
    rows = [(i, [float(2**15 * (i % 7) - i)] * 4 + [0.5] * 4, i % 2) for i in range(30)]
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)
    with pytest.raises(ValueError):
        vc.squared_distances(np.array([[2**40]]), np.array([[0]]))
    for bad in ([(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)], [(1, [1.0] * 6, 0)]):
        with pytest.raises(ValueError):
            vc.compress(spark.createDataFrame(bad, SCHEMA))


def test_empty_tables_other_columns_and_cleaning_up(spark):
    for rows in ([], [(1, None, 0)]):
        coded, books = vc.compress(spark.createDataFrame(rows, SCHEMA))
        assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    clash = spark.createDataFrame([(1, [0.5] * 4, 3, 9, 9, 9)], SCHEMA + ", code int, error int, x int")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    coded, _ = vc.compress(clash)
    assert [(r.vec_id, list(r.code), r.error, r.label_error) for r in coded.collect()] == [(1, [0, 0, 0, 0], 0, 0)]
    assert len(set(os.listdir(folder)) - before) == 1  # only the last table stays
