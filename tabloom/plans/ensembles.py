"""Tree ensembles: forests to any depth, extremely randomised trees and multiclass boosting, as fitted stages."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.trees import KINDS, MOST_NODES, TASK_ROWS, Packed, Pieces, Rules, _placed, _rows_of, grow_forest, matrix, pack, unpacked
from tabloom.session import discard, stored, stored_spread

_KINDS = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "gain": np.float64, "value": np.float64}
#: Rounds of boosting after which the scores of all rows are written down anew.
_KEEP_EVERY = 4
#: Bytes of rows that a task of a stored forest scores, about.
_PART_BYTES = 32 << 20
#: Numbers of a level of boosting that tasks send to the driver together; more are added up on the way.
_SENT_NUMBERS = 1 << 24
#: Rows in a block that is scored by a stored forest.
_SCORED_ROWS = 8_192


def class_count(rows: DataFrame, label: str) -> int:
    """Classes of an indexed label: from its names where the column has them, else by looking."""
    names = rows.schema[label].metadata.get("ml_attr", {}).get("vals")
    return len(names) if names else int(rows.agg(F.max(label)).first()[0]) + 1


def leaf_of(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Number of the leaf that each row of values comes to."""
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while len(rows):
        at = node[rows]
        inner = tree["feature"][at] >= 0
        rows, at = rows[inner], at[inner]
        node[rows] = np.where(x[rows, tree["feature"][at]] <= tree["threshold"][at], tree["left"][at], tree["right"][at])
    return node


class _Writer(MLWriter):
    def __init__(self, model: "TreeEnsemble"):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        m = self._model
        extra = {"kind": m.kind, "classes": m.classes, "features": m.features, "start": m.start, "step": m.step}
        if m.pieces is not None:
            DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra | {"rows": m.pieces.rows})
            tops = {c: pa.array([t[c].astype(k).tobytes() for t in m.pieces.tops], pa.binary()) for c, k in (_KINDS | {"task": np.uint8}).items()}
            tops["tree"] = pa.array(range(len(m.pieces.tops)), pa.int32())
            self.sparkSession.createDataFrame(pa.table(tops)).write.parquet(f"{path}/tops")
            m.pieces.table.write.parquet(f"{path}/pieces")
            return
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        columns = {"tree": pa.array(range(len(m.trees)), pa.int32())}
        columns |= {c: pa.array([t[c].astype(k).tobytes() for t in m.trees], pa.binary()) for c, k in _KINDS.items()}
        self.sparkSession.createDataFrame(pa.table(columns)).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> "TreeEnsemble":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows, trees = metadata.get("rows"), []
        kinds = _KINDS if rows is None else _KINDS | {"task": np.uint8}
        for r in self.sparkSession.read.parquet(f"{path}/{'trees' if rows is None else 'tops'}").orderBy("tree").toLocalIterator():
            tree = {c: np.frombuffer(r[c], dtype=k) for c, k in kinds.items()}
            trees.append(tree | {"value": tree["value"].reshape(len(tree["feature"]), -1)})
        pieces = None
        if rows is not None:
            table, tops = self.sparkSession.read.parquet(f"{path}/pieces"), [t | {"task": t["task"] > 0} for t in trees]
            pieces, trees = Pieces(table, [], tops, metadata["classes"], metadata["features"], rows), []
        made = TreeEnsemble(metadata["kind"], trees, metadata["classes"], metadata["features"], metadata["start"], metadata["step"], pieces)
        made._resetUid(metadata["uid"])
        return made


class TreeEnsemble(Model, MLReadable, MLWritable):
    """Fitted trees. A forest averages the class shares of its leaves; boosting adds up leaf values by class.

    Adds ``rawPrediction``, ``probability`` and ``prediction`` to rows with
    ``features``. Held trees are sent to every worker. A larger forest is a
    stored table (``pieces``): rows are stored and sent to the subtrees that
    they come to, and no process holds more than one subtree and its rows.
    """

    def __init__(
        self, kind: str = "forest", trees: list | None = None, classes: int = 0, features: int = 0, start=(), step: float = 1.0, pieces: Pieces | None = None
    ):
        super().__init__()
        self.kind, self._trees, self.classes, self.features = kind, trees or [], classes, features
        self.start, self.step, self._sent = list(start), step, None
        self.pieces, self._cuts, self._scored = pieces, None, []

    @property
    def trees(self) -> list[dict[str, np.ndarray]]:
        """All trees in this process; of a stored forest they are read anew."""
        return self._trees if self.pieces is None else self.pieces.whole()

    def release(self) -> None:
        """Delete the stored trees and the rows that they scored; nothing that reads them may be left."""
        paths = [*self._scored, *(self.pieces.paths if self.pieces is not None else [])]
        if paths:
            discard(self.pieces.table.sparkSession, *paths)
        self._scored = []

    def copy(self, extra=None) -> "TreeEnsemble":
        return self

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the gain by feature, averaged over the trees that split."""
        total = np.zeros(self.features)
        if self.pieces is not None:
            gains = self.pieces.gains()
        else:
            inner = [t["feature"] >= 0 for t in self._trees]
            gains = [np.bincount(t["feature"][i], t["gain"][i], self.features) for t, i in zip(self._trees, inner)]
        for own in gains:
            total += own / own.sum() if own.sum() else own
        return DenseVector(total / total.sum() if total.sum() else total)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Summed class shares, or scores, of rows of values."""
        out = np.zeros((len(x), self.classes)) + (np.array(self.start) if self.start else 0.0)
        for i, tree in enumerate(self.trees):
            at = leaf_of(x, tree)
            if self.kind == "forest":
                out += _shares(tree["value"][at])
            else:
                out[:, i % self.classes] += tree["value"][at, 0].astype(np.float64)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.pieces is not None:
            if self._cuts is None:
                self._cuts = self.pieces.cuts()
            scored, paths = scored_by_pieces(dataset, self.pieces, self._cuts)
            self._scored += paths
            return predicted(scored, F.transform("__raw", lambda v: v / len(self.pieces.tops)))
        if self._sent is None:
            self._sent = dataset.sparkSession.sparkContext.broadcast((self.kind, self._trees, self.classes, self.features, self.start, self.step))
        sent = self._sent

        def score(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = TreeEnsemble(*sent.value)
            for part in vectors:
                x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, model.features))
                yield pd.Series(list(model.raw(x)))

        raw = F.pandas_udf(score, "array<double>")(vector_to_array("features"))
        scored = dataset.withColumn("__raw", raw)
        if self.kind == "forest":
            return predicted(scored, F.transform("__raw", lambda v: v / len(self._trees)))
        return softmax_predicted(scored)


def _shares(value: np.ndarray) -> np.ndarray:
    """Class shares of leaves."""
    value = value.astype(np.float64)
    return value / np.maximum(value.sum(1, keepdims=True), 1e-300)


def _by_code(tree: dict[str, np.ndarray], cuts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Routing by the places of thresholds among those of their feature."""
    feature, low = tree["feature"].astype(np.int64), np.zeros(len(tree["feature"]), dtype=np.int64)
    for f in np.unique(feature[feature >= 0]).tolist():
        mine = feature == f
        low[mine] = np.searchsorted(cuts[f], tree["threshold"][mine])
    return feature, low, tree["left"].astype(np.int64), tree["right"].astype(np.int64)


def scored_by_pieces(dataset: DataFrame, pieces: Pieces, cuts: list[np.ndarray]) -> tuple[DataFrame, list[str]]:
    """Rows with the summed class shares of a stored forest, ``__raw``, and the paths of what is stored for it.

    Rows get a number and are stored. Blocks of them, as places among the
    thresholds, meet each subtree in one task, in slices of no more rows than the
    forest was fitted on; a row's shares are then added in the order of the trees.
    """
    spark = dataset.sparkSession
    kind = np.uint16 if max((len(c) for c in cuts), default=0) < 1 << 16 else np.uint32
    classes, features = pieces.classes, pieces.features
    # no number is made twice: the rows are read back as they were written
    held, rows_path = stored(dataset.withColumn("__row", F.monotonically_increasing_id()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, _SCORED_ROWS):
                part = batch.slice(at, _SCORED_ROWS)
                x, ids = matrix(part.column("x")), part.column("id").to_numpy()
                codes = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(kind)
                arrays = [pa.array([number]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "n", "ids", "codes"])
                number += 1

    numbered = held.select(F.col("__row").alias("id"), vector_to_array("features").alias("x"))
    blocks, blocks_path = stored_spread(numbered.mapInArrow(coded, "block bigint, n int, ids binary, codes binary"))
    rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-rows // max(pieces.rows, TASK_ROWS)))
    context = spark.sparkContext
    sent = context.broadcast(([t | {"by_code": _by_code(t, cuts)} for t in pieces.tops], cuts))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids = batch.column("block")[i].as_py(), batch.column("ids")[i].as_py()
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), dtype=kind).reshape(-1, features)
                yield block, ids, codes, [(t, top, _placed(codes, top["by_code"])) for t, top in enumerate(sent.value[0])]

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows' numbers, as tree -1, and the shares of those that end in a top."""
        for block, ids, _, trees in placed(batches):
            made = [(block, -1, ids, b"")]
            for t, top, node in trees:
                at = np.nonzero(~top["task"][node])[0].astype(np.int32)
                if len(at):
                    made.append((block, t, at.tobytes(), _shares(top["value"][node[at]]).tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["block", "tree", "at", "shares"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, codes, trees in placed(batches):
            for t, top, node in trees:
                made = [
                    (t, n, block % slices, block, at.astype(np.int32).tobytes(), codes[at].tobytes())
                    for n, at in _rows_of(node, np.ones(len(node)), np.nonzero(top["task"])[0].tolist())
                ]
                if made:
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["tree", "node", "slice", "block", "at", "codes"])

    def score(asked: pa.Table, piece: pa.Table) -> pa.Table:
        made = []
        if len(asked):
            tree = {c: np.frombuffer(piece[c][0].as_buffer(), dtype=k) for c, k in KINDS.items()}
            routing, value = _by_code(tree, sent.value[1]), tree["value"].reshape(-1, classes)
            t = piece["tree"][0].as_py()
            for block, at, codes in zip(*(asked[c] for c in ("block", "at", "codes"))):
                leaf = _placed(np.frombuffer(codes.as_buffer(), dtype=kind).reshape(-1, features), routing)
                made.append((block.as_py(), t, at.as_py(), _shares(value[leaf]).tobytes()))
        columns = list(zip(*made)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "tree", "at", "shares"])

    def total(block: pa.Table) -> pa.Table:
        block = block.sort_by("tree")
        ids = np.frombuffer(block["at"][0].as_buffer(), dtype=np.int64)
        out = np.zeros((len(ids), classes))
        for at, shares in zip(block["at"][1:], block["shares"][1:]):
            out[np.frombuffer(at.as_buffer(), dtype=np.int32)] += np.frombuffer(shares.as_buffer(), dtype=np.float64).reshape(-1, classes)
        raw = pa.ListArray.from_arrays(np.arange(0, out.size + 1, classes, dtype=np.int32), out.ravel())
        return pa.table({"__row": pa.array(ids), "__raw": raw})

    keys = ["tree", "node", "slice"]
    # few rows make few tasks, whose start would be most of their time
    least = 4 * context.defaultParallelism
    wanted = min(max(least, rows * len(pieces.tops) * (features + 16) // _PART_BYTES), 16 * context.defaultParallelism)
    parts = max(1, min(slices * sum(int(t["task"].sum()) for t in pieces.tops), wanted))
    asked = blocks.mapInArrow(send, "tree int, node int, slice int, block bigint, at binary, codes binary").repartition(parts, *keys)
    spread = pieces.table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, *keys)
    answer = "block bigint, tree int, at binary, shares binary"
    answers = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(score, answer)
    sums = blocks.mapInArrow(ended, answer).unionByName(answers).groupBy("block").applyInArrow(total, "__row bigint, __raw array<double>")
    raw, raw_path = stored(sums)
    discard(spark, blocks_path)
    return held.join(raw, "__row").drop("__row"), [rows_path, raw_path]


def predicted(scored: DataFrame, shares) -> DataFrame:
    """rawPrediction, probability and prediction from an array of scores, ``__raw``; the first of equals is predicted."""
    first = (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")
    return scored.withColumns(
        {"rawPrediction": array_to_vector("__raw"), "probability": array_to_vector(shares), "prediction": first}
    ).drop("__raw", "__powers")


def softmax_predicted(scored: DataFrame) -> DataFrame:
    scored = scored.withColumn("__top", F.array_max("__raw"))
    scored = scored.withColumn("__powers", F.transform("__raw", lambda v: F.exp(v - F.col("__top")))).drop("__top")
    total = F.aggregate("__powers", F.lit(0.0), lambda a, b: a + b)
    return predicted(scored, F.transform("__powers", lambda v: v / total))


@dataclass
class Forest:
    """Random forest, or with ``drawn`` extremely randomised trees; ``fit`` takes prepared rows.

    ``depth`` None grows nodes until they are pure or smaller than ``split``. A
    node looks at the square root of the features, and at more only while none of
    those can be split on. ``bins`` bounds the split points of a feature; one
    with fewer values is split between them exactly.
    """

    trees: int = 100
    depth: int | None = None
    split: int = 2
    leaf: int = 1
    drawn: bool = False
    bootstrap: bool = True
    bins: int = 32
    seed: int = 42
    label: str = "label_index"
    weight: str | None = None
    tried: int | None = None

    def fit(self, rows: DataFrame) -> TreeEnsemble:
        packed = pack(rows, self.label, class_count(rows, self.label), self.weight, bins=self.bins)
        tried = self.tried or max(1, math.isqrt(packed.features))
        rules = Rules(min(tried, packed.features), self.depth, self.split, self.leaf, self.drawn, self.bootstrap, self.seed)
        try:
            grown = grow_forest(packed, self.trees, rules)
            trees, pieces = ([], grown) if isinstance(grown, Pieces) else (grown, None)
            return TreeEnsemble("forest", trees, packed.classes, packed.features, pieces=pieces)
        finally:
            packed.release()


@dataclass
class Boosting:
    """Gradient boosting of one softmax loss over all classes; ``fit`` takes prepared rows.

    Every round grows one tree per class on the gradients y - p, all classes in
    the same passes. A level sums gradients, curvatures p (1 - p) and rows per
    (class, node, feature, bin) in every task; it is one job of one stage, as
    hundreds of small levels are a fit. A leaf adds
    step x (K - 1) / K x gradients / curvatures. Scores start from the logarithms
    of the class shares. Rows carry their scores as written some rounds ago; the
    trees since then are applied while counting.
    """

    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    leaf: int = 1
    bins: int = 32
    label: str = "label_index"
    weight: str | None = None

    def fit(self, rows: DataFrame) -> TreeEnsemble:
        packed = pack(rows, self.label, class_count(rows, self.label), self.weight, bins=self.bins)
        shares = _class_weights(packed)
        start = np.log(np.maximum(shares / shares.sum(), 1e-300))
        zero = np.zeros(0).tobytes()
        blocks = packed.blocks.withColumn("scores", F.lit(zero))
        held = _as_bytes(blocks).persist(StorageLevel.MEMORY_AND_DISK)  # over the stored copy; a level plans no query
        done: list[dict] = []
        recent: list[dict] = []
        for r in range(self.rounds):
            trees = [_Boosted() for _ in range(packed.classes)]
            for level in range(self.depth):
                asked = {k: t.open for k, t in enumerate(trees) if t.open}
                if not asked:
                    break
                sums = _gradients(packed, held, start, recent, trees, asked)
                for k, nodes in asked.items():
                    trees[k].split(nodes, {n: sums[(k, n)] for n in nodes}, packed, self, level + 1 < self.depth)
            recent += [t.arrays() for t in trees]
            if len(done) + len(recent) > MOST_NODES:
                raise ValueError("too many trees")
            if (r + 1) % _KEEP_EVERY == 0 and r + 1 < self.rounds:
                blocks, path = stored(_scored_blocks(packed, blocks, start, recent))
                held.unpersist()
                held = _as_bytes(blocks).persist(StorageLevel.MEMORY_AND_DISK)
                packed.release()
                packed.paths = [path]
                done, recent = done + recent, []
        held.unpersist()
        packed.release()
        return TreeEnsemble("boosting", done + recent, packed.classes, packed.features, start.tolist(), self.step)


def _class_weights(packed: Packed) -> np.ndarray:
    """Summed weights by class."""
    classes, kind = packed.classes, packed.bins.kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes)
        for batch in batches:
            for _, _, y, w in unpacked(batch, kind):
                total += np.bincount(y, w, classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(total)], names=["c", "w"])

    got = packed.blocks.mapInArrow(count, "c bigint, w double").groupBy("c").agg(F.sum("w").alias("w")).collect()
    out = np.zeros(classes)
    for r in got:
        out[r["c"]] = r["w"]
    return out


class _Boosted:
    """A regression tree in the making; ``open`` are the nodes of the level to be split next."""

    def __init__(self):
        self.nodes = [{"feature": -1, "low": 0, "left": -1, "right": -1, "threshold": 0.0, "gain": 0.0, "value": 0.0}]
        self.open = [0]

    def routing(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array([n[c] for n in self.nodes], dtype=np.int64) for c in ("feature", "low", "left", "right"))

    def split(self, nodes: list[int], sums: dict[int, np.ndarray], packed: Packed, how: Boosting, deeper: bool) -> None:
        """Split the asked nodes by their summed (feature, bin) gradients, curvatures and rows."""
        self.open = []
        for n in nodes:
            cells = sums[n]  # feature, bin, (gradient, curvature, rows)
            left = np.cumsum(cells, axis=1)
            total = left[0, -1]
            self.nodes[n]["value"] = _leaf_value(total, packed.classes, how.step)
            right = total - left
            able = (left[..., 2] >= how.leaf) & (right[..., 2] >= how.leaf)
            quality = lambda c: c[..., 0] ** 2 / np.maximum(c[..., 1], 1e-16)
            gain = np.where(able, quality(left) + quality(right) - quality(total), -1.0)
            best = int(np.argmax(gain))  # the lowest feature and bin of equals
            f, b = divmod(best, gain.shape[1])
            if gain[f, b] <= 1e-12:
                continue
            ends = packed.bins.ends[f]
            after = int(np.nonzero(cells[f, b + 1 :, 2])[0][0]) + b + 1
            cut = (ends[b] + ends[after]) / 2 if packed.bins.exact[f] else ends[b]
            a = len(self.nodes)
            self.nodes[n] |= {"feature": f, "low": b, "left": a, "right": a + 1, "threshold": float(cut), "gain": float(gain[f, b])}
            for side in (left[f, b], right[f, b]):
                self.nodes.append({"feature": -1, "low": 0, "left": -1, "right": -1, "threshold": 0.0, "gain": 0.0, "value": _leaf_value(side, packed.classes, how.step)})
            if deeper:
                self.open += [a, a + 1]

    def arrays(self) -> dict[str, np.ndarray]:
        out = {c: np.array([n[c] for n in self.nodes], dtype=k) for c, k in _KINDS.items() if c != "value"}
        value = np.array([[n["value"]] for n in self.nodes])
        return out | {"value": value, "low": np.array([n["low"] for n in self.nodes], dtype=np.int64)}


def _leaf_value(sums: np.ndarray, classes: int, step: float) -> float:
    return float(step * (classes - 1) / classes * sums[0] / max(sums[1], 1e-16)) if sums[1] > 0 else 0.0


def _scores(codes: np.ndarray, held: bytes, start: np.ndarray, recent: list[dict]) -> np.ndarray:
    """Scores of a block's rows: as written down, or the start, and the trees since then."""
    classes = len(start)
    out = np.frombuffer(held, dtype=np.float64).reshape(-1, classes).copy() if len(held) else np.tile(start, (len(codes), 1))
    for i, tree in enumerate(recent):
        routing = tuple(tree[c].astype(np.int64) for c in ("feature", "low", "left", "right"))
        out[:, i % classes] += tree["value"][_placed(codes, routing), 0]
    return out


def _as_bytes(blocks: DataFrame) -> RDD:
    """(codes, label, weight, scores) of every block, the way Python tasks read it fastest."""
    return blocks.select("codes", "label", "weight", "scores").rdd.map(lambda r: tuple(map(bytes, r)))


def _gradients(packed: Packed, blocks: RDD, start: np.ndarray, recent: list[dict], trees: list[_Boosted], asked: dict[int, list[int]]):
    """{(class, node): array of feature, bin, (gradient, curvature, rows)} of the asked nodes."""
    features, width, kind = packed.features, packed.bins.most, packed.bins.kind
    sent = blocks.context.broadcast((start, recent, {k: (trees[k].routing(), nodes) for k, nodes in asked.items()}))
    keys = [(k, n) for k, nodes in asked.items() for n in nodes]
    shape = len(keys), 3, features * width

    def count(rows_of: Iterator[tuple[bytes, ...]]) -> Iterator[np.ndarray]:
        begin, since, wanted = sent.value
        sums, place = np.zeros(shape), {key: i for i, key in enumerate(keys)}
        offset = np.arange(features) * width
        for codes, y, w, held in rows_of:
            y, w = np.frombuffer(y, dtype=np.int32), np.frombuffer(w, dtype=np.float64)
            codes = np.frombuffer(codes, dtype=kind).reshape(len(y), -1)
            scores = _scores(codes, held, begin, since)
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            cells = codes + offset
            for k, (routing, nodes) in wanted.items():
                at = _placed(codes, routing)
                for n in nodes:
                    rows = np.nonzero(at == n)[0]
                    if not len(rows):
                        continue
                    share, weight, where = p[rows, k], w[rows], cells[rows].ravel()
                    out = sums[place[(k, n)]]
                    for i, v in enumerate((((y[rows] == k) - share) * weight, share * (1 - share) * weight)):
                        out[i] += np.bincount(where, np.repeat(v, features), shape[2])
                    out[2] += np.bincount(where, minlength=shape[2])
        yield sums

    made = blocks.mapPartitions(count)
    if made.getNumPartitions() * math.prod(shape) > _SENT_NUMBERS:
        total = made.treeReduce(np.add)
    else:
        total = sum(made.collect(), np.zeros(shape))
    sent.destroy()
    return {key: total[i].T.reshape(features, width, 3) for i, key in enumerate(keys)}


def _scored_blocks(packed: Packed, blocks: DataFrame, start: np.ndarray, recent: list[dict]) -> DataFrame:
    """The blocks with the scores of their rows written down."""
    kind, sent = packed.bins.kind, blocks.sparkSession.sparkContext.broadcast((start, recent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                _scores(codes, batch.column("scores")[i].as_py(), *sent.value).tobytes() for i, (_, codes, _, _) in enumerate(unpacked(batch, kind))
            ]
            yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.array(made, pa.binary()))

    return blocks.mapInArrow(score, blocks.schema)
