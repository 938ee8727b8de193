"""Growing classification trees over packed rows: counted levels for large nodes, whole subtrees for small ones.

Rows are packed into blocks of bin codes, one Spark row for some thousand of
them. A node with more rows than a task should hold is split by class counts per
(tree, node, feature, bin), which every task sums before the shuffle; the rows of
a smaller node are sent to one task, which grows it to its end. Every random
choice is a hash of the seed, the tree, the node's place and the feature, so a
tree does not depend on where its nodes are grown.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import discard, stored, stored_spread

#: Rows in a block.
BLOCK_ROWS = 16_384
#: Nodes of so many rows or fewer are grown by one task.
TASK_ROWS = 1 << 18
#: Counts gathered in one pass over the rows, at most.
PASS_CELLS = 1 << 21
#: Bytes of rows sent out together, about, but those of four trees at least.
BYTES_TOGETHER = 1 << 34
#: Nodes of an ensemble that is held by the driver and every worker, at most; a larger forest stays a table.
HELD_NODES = 1 << 20
#: Nodes that ``trees`` of a stored forest reads back into one process, at most.
MOST_NODES = 40_000_000


# ---------------------------------------------------------------- packed rows


@dataclass
class Bins:
    """Upper ends of each feature's bins; ``exact`` where every bin is one value."""

    ends: list[np.ndarray]
    exact: np.ndarray

    @property
    def most(self) -> int:
        return max((len(e) for e in self.ends), default=1)

    @property
    def kind(self) -> type:
        return np.uint8 if self.most <= 256 else np.uint16

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=self.kind)
        for f, ends in enumerate(self.ends):
            out[:, f] = np.minimum(np.searchsorted(ends, x[:, f], side="left"), len(ends) - 1)
        return out

    def table(self) -> np.ndarray:
        """Ends as a matrix, padded with the last."""
        return np.array([np.pad(e, (0, self.most - len(e)), mode="edge") for e in self.ends])


@dataclass
class Packed:
    """Blocks (block, n, codes, label, weight) of the rows a model is fitted on."""

    blocks: DataFrame
    bins: Bins
    classes: int
    rows: int
    paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Delete the stored blocks."""
        discard(self.blocks.sparkSession, *self.paths)

    @property
    def features(self) -> int:
        return len(self.bins.ends)


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def learn_bins(rows: DataFrame, most: int) -> Bins:
    """Every value of a feature with at most ``most`` values, else that many quantiles; rows has an array ``x``."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] | None = None
        for batch in batches:
            x = matrix(batch.column("x"))
            if not len(x):
                continue
            held = held or [np.zeros(0)] * x.shape[1]
            for f, values in enumerate(held):
                if values is not None:
                    merged = np.union1d(values, x[:, f])
                    held[f] = merged if len(merged) <= most else None
        pairs = [(f, v) for f, values in enumerate(held or []) for v in ([None] if values is None else values)]
        columns = list(zip(*pairs)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64())], names=["feature", "value"])

    found = rows.select("x").mapInArrow(few, "feature int, value double").distinct()
    sets = found.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("over"))
    known = found.join(F.broadcast(sets.filter((F.col("over") == 0) & (F.col("n") <= most))), "feature", "left")
    # at most ``most`` values of a feature, or one row that says there are more
    got = known.groupBy("feature").agg(F.sort_array(F.collect_set(F.when(F.col("n").isNotNull(), F.col("value")))).alias("values"))
    ends = {r["feature"]: np.array(r["values"]) for r in got.collect()}
    wide = [f for f, e in ends.items() if not len(e)]
    parts = [(i + 1) / most for i in range(most)]
    for at in range(0, len(wide), 32):
        some = wide[at : at + 32]
        quantiles = rows.agg(*[F.percentile_approx(F.col("x")[f], parts, 10_000).alias(f"q{f}") for f in some]).first()
        for f in some:
            ends[f] = np.unique(np.array(quantiles[f"q{f}"]))
    exact = np.array([f not in wide for f in range(len(ends))], dtype=bool)
    return Bins([ends[f] for f in range(len(ends))], exact)


def pack(rows: DataFrame, label: str, classes: int, weight: str | None = None, features: str = "features", bins: int = 32) -> Packed:
    """Rows as stored blocks of bin codes; classes are numbered from 0."""
    columns = [vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y")]
    columns.append((F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    flat = rows.select(*columns)
    learned = learn_bins(flat, bins)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                codes = learned.codes(matrix(part.column("x")))
                y, w = part.column("y").to_numpy().astype(np.int32), part.column("w").to_numpy().astype(np.float64)
                values = [[number], [part.num_rows], [codes.tobytes()], [y.tobytes()], [w.tobytes()]]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "n", "codes", "label", "weight"])
                number += 1

    blocks, path = stored_spread(flat.mapInArrow(packed, "block bigint, n int, codes binary, label binary, weight binary"))
    count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return Packed(blocks, learned, classes, count, [path])


def unpacked(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, codes, labels, weights) of every block in an Arrow batch."""
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        y, w = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("label", np.int32), ("weight", np.float64)))
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), dtype=kind)
        yield batch.column("block")[i].as_py(), codes.reshape(n, -1), y, w


# ---------------------------------------------------------------- random choices


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_key(seed: int, tree: int) -> np.uint64:
    return mixed(np.array([seed * 1_000_003 + tree], dtype=np.uint64))[0]


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    return mixed(keys * np.uint64(2) + np.uint64(side + 1))


def feature_order(keys: np.ndarray, features: int) -> np.ndarray:
    """A permutation of the features for every node."""
    return np.argsort(mixed(keys[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1, kind="stable")


def uniform(keys: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for every (node, feature)."""
    bits = mixed(keys ^ mixed(feature.astype(np.uint64) + np.uint64(0x51_7C_C1)))
    return (bits >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree's sample with replacement holds each row of a block."""
    return np.random.Generator(np.random.Philox(key=[seed * 1_000_003 + tree, block])).poisson(1.0, n)


# ---------------------------------------------------------------- splits


@dataclass(frozen=True)
class Rules:
    """How trees grow. ``tried``: features looked at in a node; more only while none can be split on."""

    tried: int
    depth: int | None = None
    split: int = 2
    leaf: int = 1
    drawn: bool = False
    bootstrap: bool = True
    seed: int = 42


def splits(node, code, stats, totals, keys, feature, bins: Bins, ends: np.ndarray, rules: Rules):
    """(gain, code, next code) of the best split of every node on its feature; a gain of -1 says there is none.

    ``node``, ``code``: distinct pairs in order, with ``stats``, the summed class
    weights and in the last column the rows. ``feature`` is one per node. The
    gain is the fall of the summed Gini impurity. With ``drawn`` one threshold is
    drawn for each node between its smallest and largest value.
    """
    nodes = len(totals)
    gain, low, high = np.full(nodes, -1.0), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    if len(node) < 2:
        return gain, low, high
    first = np.searchsorted(node, np.arange(nodes))
    held = np.append(first, len(node))[1:] > first
    summed = np.cumsum(stats, 0)
    before = np.zeros_like(totals)
    before[held] = summed[first[held]] - stats[first[held]]
    at = np.nonzero(node[:-1] == node[1:])[0]
    if rules.drawn and len(at):
        last = np.searchsorted(node, np.arange(nodes), side="right") - 1
        least = ends[feature, code[np.minimum(first, len(code) - 1)]]
        cut = least + uniform(keys, feature) * (ends[feature, code[last]] - least)
        f = feature[node[at]]
        at = at[(ends[f, code[at]] <= cut[node[at]]) & (ends[f, code[at + 1]] > cut[node[at]])]
    if not len(at):
        return gain, low, high
    of = node[at]
    left = summed[at] - before[of]
    right = totals[of] - left
    allowed = (left[:, -1] >= rules.leaf) & (right[:, -1] >= rules.leaf)
    at, of, left, right = at[allowed], of[allowed], left[allowed, :-1], right[allowed, :-1]
    if not len(at):
        return gain, low, high

    def purity(c: np.ndarray) -> np.ndarray:
        return (c * c).sum(1) / np.maximum(c.sum(1), 1e-300)

    found = np.maximum(purity(left) + purity(right) - purity(totals[:, :-1])[of], 0.0)
    begins = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
    best = np.maximum.reduceat(found, begins)
    top = np.nonzero(found >= best[np.cumsum(np.append(True, of[1:] != of[:-1])) - 1])[0]
    owner, pick = np.unique(of[top], return_index=True)  # the lowest of equal ends
    chosen = top[pick]
    gain[owner], low[owner], high[owner] = found[chosen], code[at[chosen]], code[at[chosen] + 1]
    return gain, low, high


def thresholds(keys, feature, low, high, bins: Bins, ends: np.ndarray, rules: Rules) -> np.ndarray:
    """Values up to the threshold go left: halfway to the next value, the drawn one, or the end of a bin of many values."""
    a, b = ends[feature, low], ends[feature, high]
    exact = bins.exact[feature]
    return np.where(exact, a if rules.drawn else (a + b) / 2, a)


@dataclass
class Growth:
    """Nodes of trees in the making, as lists of arrays; children are numbers within, a leaf has feature -1."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def arrays(self) -> dict[str, np.ndarray]:
        kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "gain": np.float64, "value": np.float32}
        return {k: np.concatenate(getattr(self, k)).astype(t) for k, t in kinds.items()}


def _in_order(numbers: np.ndarray, count: int) -> np.ndarray:
    """Stable order of numbers below ``count``; numpy sorts 16 bits by radix."""
    return np.argsort(numbers.astype(np.uint16) if count <= 1 << 16 else numbers, kind="stable")


@dataclass
class _Marks:
    """Class weights and times of rows, to be summed. Sums of whole numbers are the same in any order, so they are counted."""

    y: np.ndarray
    weight: np.ndarray
    times: np.ndarray
    classes: int

    def __post_init__(self):
        self.whole = bool((self.weight == np.rint(self.weight)).all())
        self.plain = bool((self.weight == self.times).all())  # the rows of a cell are the sum over its classes
        self.table, self.held = None, (None, None)
        if not self.whole:
            self.table = np.zeros((len(self.y), self.classes + 1))
            self.table[np.arange(len(self.y)), self.y] = self.weight
            self.table[:, -1] = self.times
            self.columns = np.ascontiguousarray(self.table.T)

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Classes, weights and times of rows; those last asked for are kept, as features are tried on the same rows."""
        if self.held[0] is not rows:
            self.held = rows, (self.y.take(rows), self.weight.take(rows), None if self.plain else self.times.take(rows))
        return self.held[1]

    def counted(self, rows: np.ndarray, group: np.ndarray, groups: int, of: np.ndarray | None = None) -> np.ndarray:
        """Sums of ``rows``, or of ``rows`` in the order ``of``, by group."""
        y, weight, times = self._of(rows)
        if of is not None:
            y, weight, times = y.take(of), weight.take(of), None if times is None else times.take(of)
        cells = np.bincount(group * self.classes + y, weight, groups * self.classes).reshape(groups, self.classes)
        if self.plain:
            return np.column_stack([cells, cells.sum(1)])
        return np.column_stack([cells, np.bincount(group, times, groups)])

    def runs(self, rows: np.ndarray, begins: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Sums of the runs of rows, or of rows in the order ``of``, that begin at the given places."""
        if self.whole:
            return self.counted(rows, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows)))), len(begins), of)
        rows = rows if of is None else rows[of]
        if len(begins) * 16 <= len(rows):
            return np.stack([np.add.reduceat(c.take(rows), begins) for c in self.columns], axis=1)
        return np.add.reduceat(self.table.take(rows, axis=0), begins, axis=0)

    def cells(self, rows: np.ndarray, owner: np.ndarray, code: np.ndarray, owners: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, code) pairs that occur, in order, and their sums."""
        pair = owner * width + code
        if self.whole and owners * width <= len(rows):
            found = np.nonzero(np.bincount(pair, minlength=owners * width))[0]
            return found // width, found % width, self.counted(rows, pair, owners * width)[found]
        sort = np.argsort(code, kind="stable")
        sort = sort[_in_order(owner[sort], owners)]
        pair = pair[sort]
        begins = np.nonzero(np.append(True, pair[1:] != pair[:-1]))[0]
        return pair[begins] // width, pair[begins] % width, self.runs(rows, begins, sort)


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray, key: np.uint64, depth: int, classes: int, bins: Bins, rules: Rules) -> dict[str, np.ndarray]:
    """One subtree to its end, level by level over all its nodes; the root is node 0.

    ``times`` are the rows' counts in the sample, ``depth`` is that of the root.
    """
    features, width, ends = codes.shape[1], bins.most, bins.table()
    marks, flat = _Marks(y, w * times, times, classes), codes.ravel()
    out = Growth()
    rows, node, keys, made = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.array([key]), 1
    while len(keys):
        count = len(keys)
        order = _in_order(node, count)
        rows, node = rows[order], node[order]
        begins = np.searchsorted(node, np.arange(count))
        totals = marks.runs(rows, begins)
        ends_here = ((totals[:, :-1] > 0).sum(1) < 2) | (totals[:, -1] < rules.split) | (totals[:, -1] < 2 * rules.leaf)
        if rules.depth is not None and depth >= rules.depth:
            ends_here[:] = True
        gain, feature = np.full(count, -1.0), np.full(count, -1, dtype=np.int64)
        low, high = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        alive = np.nonzero(~ends_here)[0]
        perm = feature_order(keys[alive], features) if len(alive) else None
        slot, asking = 0, -1
        while len(alive) and slot < features:
            if len(alive) != asking:  # else the same nodes ask again
                number = np.full(count, -1, dtype=np.int64)
                number[alive] = np.arange(len(alive))
                owner = number.take(node)
                mine = np.nonzero(owner >= 0)[0]
                here, owner, asking = rows.take(mine), owner.take(mine), len(alive)
                first = here * features
            asked = perm[:, slot]
            of, code, stats = marks.cells(here, owner, flat.take(first + asked.take(owner)), len(alive), width)
            got, a, b = splits(of, code, stats, totals[alive], keys[alive], asked, bins, ends, rules)
            better = (got > gain[alive]) | ((got >= 0) & (got == gain[alive]) & (asked < feature[alive]))
            at = alive[better]
            gain[at], feature[at], low[at], high[at] = got[better], asked[better], a[better], b[better]
            slot += 1
            stay = np.ones(len(alive), dtype=bool) if slot < rules.tried else gain[alive] < 0
            alive, perm = alive[stay], perm[stay]
        parted = np.nonzero(feature >= 0)[0]
        child = np.full(count, -1, dtype=np.int64)
        child[parted] = np.arange(len(parted))
        cut = np.zeros(count)
        cut[parted] = thresholds(keys[parted], feature[parted], low[parted], high[parted], bins, ends, rules)
        out.feature.append(feature)
        out.threshold.append(cut)
        out.left.append(np.where(child >= 0, made + 2 * child, -1))
        out.right.append(np.where(child >= 0, made + 2 * child + 1, -1))
        out.gain.append(np.maximum(gain, 0.0))
        out.value.append(totals[:, :-1])
        made += 2 * len(parted)
        going = child[node] >= 0
        rows, node = rows[going], node[going]
        side = flat.take(rows * features + feature[node]) > low[node]
        node = 2 * child[node] + side
        keys = np.stack([child_keys(keys[parted], 0), child_keys(keys[parted], 1)], 1).ravel()
        depth += 1
    return out.arrays()


# ---------------------------------------------------------------- trees over Spark


class _Tree:
    """The counted top of one tree: nodes by number; those to be grown by a task are marked."""

    def __init__(self, key: np.uint64):
        self.nodes = [{"key": key, "depth": 0, "feature": -1, "state": "open", "tried": 0, "best": None}]

    def open(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n["state"] == "open"]

    def routing(self) -> tuple[np.ndarray, ...]:
        get = lambda k, none: np.array([n.get(k, none) for n in self.nodes], dtype=np.int64)
        return get("feature", -1), get("low", 0), get("left", -1), get("right", -1)


def _placed(codes: np.ndarray, routing: tuple[np.ndarray, ...]) -> np.ndarray:
    """Node that each row has come to."""
    feature, low, left, right = routing
    node = np.zeros(len(codes), dtype=np.int64)
    while True:
        f = feature[node]
        going = np.nonzero(f >= 0)[0]
        if not len(going):
            return node
        n = node[going]
        node[going] = np.where(codes[going, f[going]] <= low[n], left[n], right[n])


def _sample(rules: Rules, tree: int, block: int, n: int) -> np.ndarray:
    return draws(rules.seed, tree, block, n) if rules.bootstrap else np.ones(n, dtype=np.int64)


def _rows_of(at: np.ndarray, times: np.ndarray, nodes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its sampled rows in order) of the asked nodes; the rows are sorted once, however many nodes there are."""
    held = np.nonzero(times > 0)[0]
    held = held[np.argsort(at[held], kind="stable")]
    low, high = (np.searchsorted(at[held], nodes, side=side) for side in ("left", "right"))
    for node, a, b in zip(nodes, low.tolist(), high.tolist()):
        if b > a:
            yield node, held[a:b]


def _counted(packed: Packed, asked: list[tuple[int, int, np.ndarray]], routings: dict, rules: Rules):
    """Class weights and rows per (tree, node, feature, bin) of the asked nodes, as {(tree, node, feature): matrix}."""
    width, classes, kind = packed.bins.most, packed.classes, packed.bins.kind
    by_tree: dict[int, list[tuple[int, np.ndarray]]] = {}
    for tree, node, features in asked:
        by_tree.setdefault(tree, []).append((node, features))
    sent = packed.blocks.sparkSession.sparkContext.broadcast((by_tree, {t: routings[t] for t in by_tree}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, routes = sent.value
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for block, codes, y, w in unpacked(batch, kind):
                for tree, nodes in wanted.items():
                    at = _placed(codes, routes[tree])
                    times = _sample(rules, tree, block, len(y))
                    asked_of = dict(nodes)
                    for node, rows in _rows_of(at, times, list(asked_of)):
                        for f in asked_of[node].tolist():
                            code = codes[rows, f].astype(np.int64)
                            cells = np.bincount(code * classes + y[rows], (w * times)[rows], width * classes).reshape(width, classes)
                            both = np.column_stack([cells, np.bincount(code, times[rows], width)])
                            key = (tree, node, f)
                            sums[key] = sums[key] + both if key in sums else both
        for (tree, node, f), both in sums.items():  # one row for each asked feature and task
            arrays = [pa.array([v], pa.int32()) for v in (tree, node, f)]
            listed = pa.array([both.ravel().tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*arrays, listed], names=["tree", "node", "feature", "cells"])

    parts = packed.blocks.mapInArrow(count, "tree int, node int, feature int, cells array<double>")
    flat = parts.select("tree", "node", "feature", F.posexplode("cells").alias("at", "v")).filter("v <> 0")
    table = flat.groupBy("tree", "node", "feature", "at").agg(F.sum("v").alias("v")).toArrow()
    out = {(t, n, int(f)): np.zeros(width * (classes + 1)) for t, n, features in asked for f in features}
    t, n, f, at, v = (table[c].to_numpy() for c in ("tree", "node", "feature", "at", "v"))
    order = np.lexsort((f, n, t))
    t, n, f, at, v = (a[order] for a in (t, n, f, at, v))
    starts = np.nonzero(np.append(True, (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (f[1:] != f[:-1])))[0] if len(t) else []
    for a, b in zip(starts, [*starts[1:], len(t)]):
        out[(int(t[a]), int(n[a]), int(f[a]))][at[a:b]] = v[a:b]
    return {k: v.reshape(width, classes + 1) for k, v in out.items()}


def _split_open(packed: Packed, trees: list[_Tree], rules: Rules) -> None:
    """One counted level: decide every open node by the next features it tries, in passes of bounded size."""
    each = max(1, packed.bins.most * (packed.classes + 1))
    waiting = [(t, i) for t, tree in enumerate(trees) for i in tree.open()]
    routings = {t: trees[t].routing() for t in {t for t, _ in waiting}}
    step = max(1, PASS_CELLS // (each * rules.tried))
    ends = packed.bins.table()
    for at in range(0, len(waiting), step):
        asked = []
        for t, i in waiting[at : at + step]:
            n = trees[t].nodes[i]
            n["order"] = n.get("order", feature_order(np.array([n["key"]]), packed.features)[0])
            more = 1 if n["tried"] else rules.tried  # one after the other once none of the first can be split on
            asked.append((t, i, n["order"][n["tried"] : n["tried"] + more]))
        counts = _counted(packed, asked, routings, rules)
        for t, i, features in asked:
            _decide(trees[t], i, features, counts, t, packed, ends, rules)


def _decide(tree: _Tree, i: int, features: np.ndarray, counts: dict, t: int, packed: Packed, ends: np.ndarray, rules: Rules) -> None:
    n = tree.nodes[i]
    first = counts[(t, i, int(features[0]))]
    total = first.sum(0)
    n["total"] = total[:-1]
    rows, ends_here = total[-1], (total[:-1] > 0).sum() < 2 or total[-1] < max(rules.split, 2 * rules.leaf)
    if ends_here or (rules.depth is not None and n["depth"] >= rules.depth):
        n["state"] = "leaf"
        return
    if rows <= TASK_ROWS:
        n["state"] = "task"
        return
    keys = np.array([n["key"]])
    for f in features.tolist():
        cells = counts[(t, i, f)]
        code = np.nonzero(cells[:, -1])[0]
        gain, low, high = splits(np.zeros(len(code), dtype=np.int64), code, cells[code], total[None], keys, np.array([f]), packed.bins, ends, rules)
        best = n["best"]
        if gain[0] >= 0 and (best is None or gain[0] > best[0] or gain[0] == best[0] and f < best[1]):
            n["best"] = (gain[0], f, int(low[0]), int(high[0]))
    n["tried"] += len(features)
    if n["best"] is None:
        if n["tried"] >= packed.features:
            n["state"] = "leaf"
        return
    gain, f, low, high = n["best"]
    cut = thresholds(keys, np.array([f]), np.array([low]), np.array([high]), packed.bins, ends, rules)[0]
    n |= {"state": "split", "feature": f, "low": low, "gain": gain, "threshold": cut, "left": len(tree.nodes), "right": len(tree.nodes) + 1}
    for side in (0, 1):
        tree.nodes.append({"key": child_keys(keys, side)[0], "depth": n["depth"] + 1, "feature": -1, "state": "open", "tried": 0, "best": None})


PIECES = "tree int, node int, feature binary, threshold binary, left binary, right binary, gain binary, value binary"
KINDS = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "gain": np.float64, "value": np.float32}


def _grown(packed: Packed, trees: list[_Tree], numbers: Sequence[int], rules: Rules) -> str | None:
    """Path of the stored subtrees of the marked nodes of some trees: their rows meet in one task each, which is at most TASK_ROWS rows."""
    marked = {t: {i: (n["key"], n["depth"]) for i, n in enumerate(trees[t].nodes) if n["state"] == "task"} for t in numbers}
    routings = {t: trees[t].routing() for t in numbers if marked[t]}
    if not routings:
        return None
    context = packed.blocks.sparkSession.sparkContext
    sent, learned = context.broadcast((marked, routings)), context.broadcast(packed.bins)
    classes, features, kind = packed.classes, packed.features, packed.bins.kind

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, routes = sent.value
        for batch in batches:
            for block, codes, y, w in unpacked(batch, kind):
                for tree, routing in routes.items():
                    at, times = _placed(codes, routing), _sample(rules, tree, block, len(y))
                    held = []
                    for node, rows in _rows_of(at, times, list(wanted[tree])):
                        parts = (codes[rows], y[rows], w[rows], times[rows].astype(np.int32))
                        held.append((tree, node, block, *[p.tobytes() for p in parts]))
                    if held:
                        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
                        arrays = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["tree", "node", "block", "codes", "label", "weight", "times"])

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")  # sums do not depend on the order of arrival
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        read = lambda c, t: np.frombuffer(b"".join(group[c].to_pylist()), dtype=t)
        key, depth = sent.value[0][tree][node]
        y = read("label", np.int32)
        made = grow(read("codes", kind).reshape(len(y), features), y, read("weight", np.float64), read("times", np.int32), key, depth, classes, learned.value, rules)
        names = ["feature", "threshold", "left", "right", "gain", "value"]
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), **{c: pa.array([made[c].tobytes()], pa.binary()) for c in names}})

    parts = packed.blocks.mapInArrow(send, "tree int, node int, block bigint, codes binary, label binary, weight binary, times binary")
    groups = sum(map(len, marked.values()))
    # a number of partitions that is asked for is not merged: small nodes are little data but much work
    dealt = parts.repartition(min(groups, 16 * context.defaultParallelism), "tree", "node")
    return stored(dealt.groupBy("tree", "node").applyInArrow(finish, PIECES))[1]


@dataclass
class Pieces:
    """A forest as counted tops, which the driver holds, and a stored table of grown subtrees.

    A top has a node for about every TASK_ROWS rows; ``task`` marks the nodes
    whose subtree is a row (tree, node, arrays as bytes) of ``table``.
    """

    table: DataFrame
    paths: list[str]
    tops: list[dict[str, np.ndarray]]
    classes: int
    features: int
    rows: int

    def nodes(self) -> int:
        held = sum(len(t["feature"]) for t in self.tops)
        return held + int(self.table.agg(F.coalesce(F.sum(F.octet_length("feature")), F.lit(0))).first()[0]) // 4

    def gains(self) -> np.ndarray:
        """Summed gain by tree and feature."""
        features, out = self.features, np.zeros((len(self.tops), self.features))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    feature, gain = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=KINDS[c]) for c in ("feature", "gain"))
                    inner = feature >= 0
                    total = np.bincount(feature[inner], gain[inner], features)
                    tree = np.full(features, batch.column("tree")[i].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(np.arange(features), pa.int32()), pa.array(total)], names=["t", "f", "g"])

        for t, top in enumerate(self.tops):
            inner = top["feature"] >= 0
            out[t] = np.bincount(top["feature"][inner], top["gain"][inner], features)
        found = self.table.select("tree", "feature", "gain").mapInArrow(summed, "t int, f int, g double")
        for r in found.groupBy("t", "f").agg(F.sum("g").alias("g")).toLocalIterator():
            out[r["t"], r["f"]] += r["g"]
        return out

    def cuts(self) -> list[np.ndarray]:
        """Thresholds of every feature in order; their number is bounded by the bins."""

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    feature, cut = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=KINDS[c]) for c in ("feature", "threshold"))
                    found = [(f, v) for f in np.unique(feature[feature >= 0]).tolist() for v in np.unique(cut[feature == f]).tolist()]
                    columns = list(zip(*found)) or [(), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64())], names=["f", "v"])

        found = self.table.select("feature", "threshold").mapInArrow(distinct, "f int, v double").distinct().toArrow()
        f, v = (found[c].to_numpy() for c in ("f", "v"))
        own = [(t["feature"], t["threshold"]) for t in self.tops]
        return [np.unique(np.concatenate([v[f == i], *[c[g == i] for g, c in own]])) for i in range(self.features)]

    def whole(self) -> list[dict[str, np.ndarray]]:
        """All trees in this process."""
        if (nodes := self.nodes()) > MOST_NODES:
            raise ValueError(f"the trees have {nodes} nodes, too many for one process; use the stored table")
        found = {}
        for r in self.table.toLocalIterator():
            made = {c: np.frombuffer(r[c], dtype=k) for c, k in KINDS.items()}
            found[(r["tree"], r["node"])] = made | {"value": made["value"].reshape(-1, self.classes)}
        return [_joined(top, t, found) for t, top in enumerate(self.tops)]

    def release(self) -> None:
        discard(self.table.sparkSession, *self.paths)


def _top(tree: _Tree, classes: int) -> dict[str, np.ndarray]:
    get = lambda k, none: np.array([x.get(k, none) for x in tree.nodes])
    value = np.array([x.get("total", np.zeros(classes)) for x in tree.nodes], dtype=np.float32).reshape(len(tree.nodes), classes)
    parts = {"feature": get("feature", -1), "threshold": get("threshold", 0.0).astype(float), "left": get("left", -1), "right": get("right", -1), "gain": get("gain", 0.0).astype(float), "value": value}
    return parts | {"task": np.array([x["state"] == "task" for x in tree.nodes])}


def _joined(top: dict[str, np.ndarray], t: int, subtrees: dict) -> dict[str, np.ndarray]:
    """The counted top with its grown subtrees, as one tree."""
    parts = {k: [top[k].copy()] for k in KINDS}
    size = len(top["feature"])
    for i in np.nonzero(top["task"])[0].tolist():
        sub = subtrees[(t, i)]
        # the subtree's root takes the place of the marked node; the rest follows
        for k in ("feature", "threshold", "gain", "value"):
            parts[k][0][i] = sub[k][0]
            parts[k].append(sub[k][1:])
        for k in ("left", "right"):
            moved = np.where(sub[k] >= 0, sub[k] + size - 1, -1)
            parts[k][0][i] = moved[0]
            parts[k].append(moved[1:])
        size += len(sub["feature"]) - 1
    return {k: np.concatenate(v) for k, v in parts.items()}


def grow_forest(packed: Packed, trees: int, rules: Rules) -> list[dict[str, np.ndarray]] | Pieces:
    """Trees as arrays of nodes: feature (-1 in a leaf), threshold, left, right, gain and value, the class weights.

    More than HELD_NODES nodes stay a table and come as ``Pieces``.
    """
    tops = [_Tree(node_key(rules.seed, t)) for t in range(trees)]
    if packed.rows <= TASK_ROWS // 2:  # even with rows drawn twice a root is no larger than a task may hold
        for top in tops:
            top.nodes[0]["state"] = "task"
    while any(top.open() for top in tops):
        _split_open(packed, tops, rules)
    together = max(4, BYTES_TOGETHER // max(1, packed.rows * (packed.features + 16)))
    made = [_grown(packed, tops, range(at, min(at + together, trees)), rules) for at in range(0, trees, together)]
    paths, heads = [p for p in made if p], [_top(t, packed.classes) for t in tops]
    if not paths:
        return [_joined(head, t, {}) for t, head in enumerate(heads)]
    table = packed.blocks.sparkSession.read.schema(PIECES).parquet(*paths)
    pieces = Pieces(table, paths, heads, packed.classes, packed.features, packed.rows)
    if pieces.nodes() > HELD_NODES:
        return pieces
    whole = pieces.whole()
    pieces.release()
    return whole
