"""Tree ensembles against plain versions, and wherever their nodes are grown."""

import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector

from tabloom.operators import trees
from tabloom.plans.ensembles import Boosting, Forest, TreeEnsemble, leaf_of
from tabloom.session import ensure_checkpoint_dir


def _data(n=900, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.random(n) < 0.1, rng.normal(size=n).round(1), np.full(n, 4.0)])
    y = ((x[:, 0] > 4).astype(int) + (x[:, 3] > 0.2)) % classes
    return x.astype(float), np.where(rng.random(n) < 0.15, rng.integers(0, classes, n), y)


def _frame(spark, x, y, parts=5):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, x array<double>, label_index double").repartition(parts, "k")
    return df.withColumn("features", array_to_vector("x"))


def _gini(y, classes):
    c = np.bincount(y, minlength=classes).astype(float)
    return (c * c).sum() / c.sum()


def _plain(x, y, classes, split=2, leaf=1, depth=None):
    """A tree that tries every cut of every feature; nested tuples of (feature, threshold, left, right) or counts."""
    counts = tuple(np.bincount(y, minlength=classes))
    if len(set(y)) < 2 or len(y) < split or depth == 0:
        return counts
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            gain = _gini(y[left], classes) + _gini(y[~left], classes) - _gini(y, classes)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2)
    if best is None:
        return counts
    left = x[:, best[1]] <= best[2]
    rest = None if depth is None else depth - 1
    sides = [_plain(x[s], y[s], classes, split, leaf, rest) for s in (left, ~left)]
    return (best[1], round(best[2], 9), *sides)


def _nested(tree, i=0):
    if tree["feature"][i] < 0:
        return tuple(int(v) for v in tree["value"][i])
    return (int(tree["feature"][i]), round(float(tree["threshold"][i]), 9), _nested(tree, tree["left"][i]), _nested(tree, tree["right"][i]))


@pytest.mark.parametrize("rule", [{}, {"split": 40}, {"leaf": 15}, {"depth": 3}])
def test_one_tree_equals_a_plain_one(spark, rule):
    x, y = _data()
    fitted = Forest(trees=1, bootstrap=False, tried=5, bins=255, **rule).fit(_frame(spark, x, y))
    # equal gains go to the lower feature and cut, in floating point up to the last bits
    assert _nested(fitted.trees[0])[:2] == _plain(x, y, 3, **rule)[:2]
    counts = fitted.trees[0]["value"][leaf_of(x, fitted.trees[0])]
    if not rule:
        shares = counts[np.arange(len(y)), y] / counts.sum(1)
        same = {tuple(r): set() for r in x.tolist()}
        for r, c in zip(x.tolist(), y.tolist()):
            same[tuple(r)].add(c)
        assert all(s == 1 or len(same[tuple(r)]) > 1 for s, r in zip(shares, x.tolist()))  # pure to the end
    sizes = fitted.trees[0]["value"].sum(1)
    inner = fitted.trees[0]["feature"] >= 0
    assert (sizes[inner] >= rule.get("split", 2)).all() and (sizes[~inner] >= rule.get("leaf", 1)).all()


@pytest.mark.parametrize("kind", [{}, {"drawn": True, "bootstrap": False}, {"tried": 1, "split": 8}])
def test_counted_levels_and_tasks_grow_the_same_trees(spark, monkeypatch, kind):
    x, y = _data(1500)
    df = _frame(spark, x, y).cache()
    packed = trees.pack(df, "label_index", 3)
    packed.paths = []  # shared by the fits below
    monkeypatch.setattr(trees, "pack", lambda *a, **k: packed)
    monkeypatch.setattr("tabloom.plans.ensembles.pack", lambda *a, **k: packed)
    whole = Forest(trees=4, seed=7, **kind).fit(df)
    for rows, cells in ((120, 1 << 22), (1, 400)):
        monkeypatch.setattr(trees, "TASK_ROWS", rows)
        monkeypatch.setattr(trees, "PASS_CELLS", cells)
        parted = Forest(trees=4, seed=7, depth=3 if rows == 1 else None, **kind).fit(df)
        if rows == 1:
            monkeypatch.setattr(trees, "TASK_ROWS", 1 << 18)
            whole = Forest(trees=4, seed=7, depth=3, **kind).fit(df)
        assert [_nested(t) for t in parted.trees] == [_nested(t) for t in whole.trees]
        assert np.allclose(parted.featureImportances.toArray(), whole.featureImportances.toArray())
    df.unpersist()


def test_deeper_than_thirty_levels(spark):
    x = np.arange(64.0)[:, None]
    y = np.arange(64) % 2
    fitted = Forest(trees=1, bootstrap=False, bins=64, drawn=True, depth=60, seed=3).fit(_frame(spark, x, y, 2))
    assert (fitted.raw(x).argmax(1) == y).all()
    chain = np.array([[2.0 ** -i] for i in range(40)])
    fitted = Forest(trees=1, bootstrap=False, bins=64, depth=99, seed=1).fit(_frame(spark, chain, np.arange(40) % 2, 2))
    assert (fitted.raw(chain).argmax(1) == np.arange(40) % 2).all()


def test_drawn_thresholds_repeat_for_a_seed(spark):
    x, y = _data()
    df = _frame(spark, x, y).cache()
    one, two, other = (Forest(trees=3, drawn=True, bootstrap=False, bins=255, seed=s).fit(df) for s in (1, 1, 2))
    assert [_nested(t) for t in one.trees] == [_nested(t) for t in two.trees] != [_nested(t) for t in other.trees]
    cuts = {round(float(c), 9) for t in one.trees for c, f in zip(t["threshold"], t["feature"]) if f == 3}
    assert len(cuts) > 10


def test_wide_features_use_quantiles_and_gaps_in_classes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    y = np.where(x[:, 0] > 0.3, 2, 0)  # class 1 never occurs
    fitted = Forest(trees=5, bins=16, tried=2).fit(_frame(spark, x, y))
    assert (fitted.raw(x).argmax(1) == y).mean() > 0.97 and fitted.classes == 3
    one = Forest(trees=2).fit(_frame(spark, x, np.zeros(2000, dtype=int)))
    assert [len(t["feature"]) for t in one.trees] == [1, 1] and not one.featureImportances.toArray().any()


def _plain_boosting(x, y, classes, rounds, depth, step=0.1):
    shares = np.bincount(y, minlength=classes) / len(y)
    scores = np.tile(np.log(shares), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(classes):
            g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])

            def grow(rows, left):
                value = step * (classes - 1) / classes * g[rows].sum() / h[rows].sum()
                best = None
                for f in range(x.shape[1] if left else 0):
                    for a in np.unique(x[rows, f])[:-1]:
                        s = x[rows, f] <= a
                        q = lambda r: g[r].sum() ** 2 / h[r].sum()  # noqa: B023, E731
                        gain = q(rows[s]) + q(rows[~s]) - q(rows)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, s)
                if best is None:
                    scores[rows, k] += value
                else:
                    grow(rows[best[1]], left - 1)
                    grow(rows[~best[1]], left - 1)

            grow(np.arange(len(y)), depth)
    return scores


def test_boosting_equals_a_plain_one(spark, monkeypatch):
    x, y = _data(400)
    monkeypatch.setattr("tabloom.plans.ensembles._KEEP_EVERY", 2)  # scores are written down on the way
    fitted = Boosting(rounds=5, depth=2, bins=255).fit(_frame(spark, x, y))
    assert np.allclose(fitted.raw(x), _plain_boosting(x, y, 3, 5, 2), atol=1e-9)


def test_scored_saved_and_read_back(spark, tmp_path):
    x, y = _data(300)
    df = _frame(spark, x, y).cache()
    for name, est in (("f", Forest(trees=3)), ("b", Boosting(rounds=2, depth=2))):
        fitted = est.fit(df)
        out = fitted.transform(df)
        assert {"rawPrediction", "probability", "prediction"} <= set(out.columns)
        shares = np.array([r.probability.toArray() for r in out.orderBy("k").collect()])
        assert np.allclose(shares.sum(1), 1) and (shares.argmax(1) == fitted.raw(x).argmax(1)).all()
        PipelineModel([fitted]).write().overwrite().save(str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name)).stages[0]
        assert isinstance(again, TreeEnsemble) and np.array_equal(again.raw(x), fitted.raw(x))
        assert out.limit(0).count() == 0
    df.unpersist()


def test_stored_blocks_are_deleted(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    x, y = _data(200)
    df, before = _frame(spark, x, y).cache(), set(os.listdir(folder))
    Forest(trees=2).fit(df)
    Boosting(rounds=1, depth=1).fit(df)
    assert set(os.listdir(folder)) == before


@pytest.mark.parametrize("task_rows", [1 << 18, 300])
def test_a_stored_forest_equals_a_held_one(spark, monkeypatch, tmp_path, task_rows):
    x, y = _data(1500)
    odd = np.concatenate([x, x + 0.25, np.full((1, 5), np.nan), x[:1] * 1e9])  # values that no tree has seen
    df, asked = _frame(spark, x, y).cache(), _frame(spark, odd, np.zeros(len(odd))).cache()
    monkeypatch.setattr(trees, "TASK_ROWS", task_rows)
    rows = lambda m: [(r.k, r.prediction, r.rawPrediction, r.probability) for r in m.transform(asked).orderBy("k").collect()]
    for kind in ({}, {"drawn": True, "bootstrap": False}, {"depth": 2}):
        monkeypatch.setattr(trees, "HELD_NODES", 1 << 20)
        held = Forest(trees=5, **kind).fit(df)
        monkeypatch.setattr(trees, "HELD_NODES", 0)
        monkeypatch.setattr("tabloom.plans.ensembles._SCORED_ROWS", 200)
        monkeypatch.setattr("tabloom.plans.ensembles.TASK_ROWS", 1)  # more rows than were fitted on come in slices
        folder = ensure_checkpoint_dir(spark).removeprefix("file:")
        before = set(os.listdir(folder))
        stored = Forest(trees=5, **kind).fit(df)
        if stored.pieces is None:  # counted to its end
            continue
        assert not stored._trees and sum(len(t["feature"]) for t in stored.pieces.tops) < sum(len(t["feature"]) for t in held.trees)
        assert [_nested(t) for t in stored.trees] == [_nested(t) for t in held.trees]
        assert np.allclose(stored.featureImportances.toArray(), held.featureImportances.toArray())
        assert rows(stored) == rows(held)
        path = str(tmp_path / f"{task_rows}-{len(kind)}-{kind.get('depth')}")
        PipelineModel([stored]).write().overwrite().save(path)
        again = PipelineModel.load(path).stages[0]
        assert again.pieces is not None and rows(again) == rows(held)
        assert stored.transform(asked.limit(0)).count() == 0
        stored.release()
        again.release()
        assert set(os.listdir(folder)) == before
    df.unpersist()
    asked.unpersist()


def test_summed_marks_are_those_of_sorted_rows():
    """Counted and radix-sorted sums are, to the bit, those of rows sorted by node and code."""
    import tabloom.operators.trees as grown

    rng = np.random.default_rng(5)
    n, classes, width = 4000, 3, 8
    y, times = rng.integers(0, classes, n), rng.integers(1, 4, n)
    for weight, owners in ((1.0, 3), (1.0, 900), (0.3 + rng.random(n), 3), (0.3 + rng.random(n), 900)):
        owner, code = np.sort(rng.integers(0, owners, n)), rng.integers(0, width, n).astype(np.uint8)
        rows = rng.permutation(n)
        plain = np.zeros((n, classes + 1))
        plain[np.arange(n), y], plain[:, -1] = weight * times, times
        order = np.argsort(owner * width + code, kind="stable")
        pair = (owner * width + code)[order]
        begins = np.nonzero(np.append(True, pair[1:] != pair[:-1]))[0]
        marks = grown._Marks(y, weight * times, times, classes)
        of, codes, sums = marks.cells(rows, owner, code, owners, width)
        assert marks.whole == np.isscalar(weight)
        assert np.array_equal(of * width + codes, pair[begins])
        assert np.array_equal(sums, np.add.reduceat(plain[rows[order]], begins, axis=0))


def test_blocks_are_dealt_to_all_cores(spark, monkeypatch):
    """Rows that come in one part are packed in their order, but their blocks are worked on by several tasks."""
    monkeypatch.setattr("tabloom.operators.trees.BLOCK_ROWS", 50)
    x, y = _data(400)
    packed = trees.pack(_frame(spark, x, y).coalesce(1), "label_index", 3)
    assert packed.blocks.rdd.getNumPartitions() > 1
    assert [r.block for r in packed.blocks.orderBy("block").collect()] == list(range(8))
    packed.release()


def test_a_level_of_boosting_is_one_stage(spark, monkeypatch):
    from tabloom.plans import ensembles

    x, y = _data(300)
    context, seen, inner = spark.sparkContext, [], ensembles._gradients

    def watched(*args):
        context.setJobGroup(f"level-{len(seen)}", "a level")
        out = inner(*args)
        seen.append(context.statusTracker().getJobIdsForGroup(f"level-{len(seen)}"))
        context.setJobGroup("rest", "rest")
        return out

    monkeypatch.setattr(ensembles, "_gradients", watched)
    fitted = Boosting(rounds=3, depth=2, bins=255).fit(_frame(spark, x, y))
    infos = [context.statusTracker().getJobInfo(j) for jobs in seen for j in jobs]
    assert len(seen) == 6 and all(len(jobs) == 1 for jobs in seen) and all(len(i.stageIds) == 1 for i in infos)
    monkeypatch.setattr(ensembles, "_SENT_NUMBERS", 1)  # sums are added up on the way
    again = Boosting(rounds=3, depth=2, bins=255).fit(_frame(spark, x, y))
    assert np.allclose(again.raw(x), fitted.raw(x))
