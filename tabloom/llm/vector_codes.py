"""Vector code compression: product codes whose codebooks are fitted by exact ball k-means on integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, ShortType, StructField, StructType

from tabloom.llm.common import discard, is_empty, stored
from tabloom.operators.lookup import is_small

#: Components are multiplied by this and rounded down.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows assigned together in a task, at most; bounds a task's memory.
TASK_ROWS = 32_768
#: Outer edges of the rings of a ball, by number of neighbours nearer than the ring; doubled twice each.
_FIRST_RING = 4
#: Distances between members and all entries held at once.
_CELLS = 1 << 22


@dataclass(frozen=True)
class Codebooks:
    """entries[part] holds an integer vector per row; ``near[part]`` the squared distances between them."""

    entries: list[np.ndarray]

    @property
    def near(self) -> list[np.ndarray]:
        return [squared_distances(e, e) for e in self.entries]

    def digest(self) -> str:
        numbers = ",".join(str(int(x)) for e in self.entries for x in e.ravel())
        return hashlib.sha256(numbers.encode()).hexdigest()


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as int64; refuses what 64 bits cannot hold."""
    most = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    bound = (2 * most) ** 2 * max(1, x.shape[1])
    if bound < 2**53:  # every product and sum is an integer that doubles hold
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    if bound >= 2**63:
        raise ValueError("components are too large for exact 64-bit distances")
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - c[None, :, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each vector, the lowest of equals, and its squared distance, by comparing all."""
    code, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    step = max(1, _CELLS // max(1, len(entries)))
    for at in range(0, len(x), step):
        d = squared_distances(x[at : at + step], entries)
        code[at : at + step] = d.argmin(1)
        best[at : at + step] = d.min(1)
    return code, best


def own_distances(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the entry it belongs to."""
    most = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    if (2 * most) ** 2 * max(1, x.shape[1]) >= 2**63:
        raise ValueError("components are too large for exact 64-bit distances")
    gap = x - entries[code]
    return (gap * gap).sum(1)


def moved(x: np.ndarray, entries: np.ndarray, near: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``nearest``, from the entry that each vector belonged to before the entries moved.

    Members of an entry form a ball about its new place. With distances d to the
    own entry and D between entries, another entry j can only be as near if
    D <= 2 d. So the ball's radius, its largest d, names the neighbours; members
    nearer than half the way to the first neighbour are the stable core and stay;
    the others lie in rings between the half ways to the t-th and the next
    neighbour and are compared with the first t neighbours only. Comparisons are
    of integers, and entries exactly as far count, so ties go to the lowest index.
    """
    code, best = before.copy(), own_distances(x, entries, before)
    members = np.argsort(before, kind="stable")
    cuts = np.searchsorted(before[members], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = members[cuts[i] : cuts[i + 1]]
        if not len(ball):
            continue
        reach = 4 * best[ball]  # D <= 2 d, squared
        neighbours = np.nonzero(near[i] <= reach.max())[0]
        neighbours = neighbours[neighbours != i]
        if not len(neighbours):
            continue
        neighbours = neighbours[np.argsort(near[i][neighbours], kind="stable")]
        count = np.searchsorted(near[i][neighbours], reach, side="right")
        inner, edge = 0, _FIRST_RING
        while inner < len(neighbours):
            ring = ball[(count > inner) & (count <= edge)]
            if len(ring):
                candidates = np.sort(np.append(neighbours[:edge], i))
                found, d = nearest(x[ring], entries[candidates])
                code[ring], best[ring] = candidates[found], d
            inner, edge = edge, edge * 4
    return code, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width) if len(column) else np.zeros((0, width), dtype=values.dtype)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to TASK_ROWS, so that the balls of a task are well filled."""
    held, rows = [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and rows + batch.num_rows > TASK_ROWS:
            yield whole()
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield whole()


def _assigned(df: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """df(vec_id, label, x, code) with new codes and ``error``, the distances summed over the parts.

    The codebooks sent out are PARTS x ENTRIES vectors, whatever the rows.
    """
    sent = df.sparkSession.sparkContext.broadcast((books.entries, books.near))
    part = width // PARTS
    schema = StructType([*df.schema.fields, StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, near = sent.value
        for batch in _chunks(batches):
            x = _matrix(batch.column("x"), width).astype(np.int64)
            fresh = batch.column("code").null_count == batch.num_rows
            before = None if fresh else _matrix(batch.column("code"), PARTS).astype(np.int64)
            codes, error = [], np.zeros(batch.num_rows, dtype=np.int64)
            for p in range(PARTS):
                own = np.ascontiguousarray(x[:, p * part : (p + 1) * part])
                code, d = nearest(own, entries[p]) if fresh else moved(own, entries[p], near[p], before[:, p])
                codes.append(code)
                error += d
            made = np.stack(codes, 1).astype(np.int16)
            offsets = np.arange(0, made.size + 1, PARTS, dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), listed, pa.array(error)], names=["vec_id", "label", "x", "code", "error"])

    return df.mapInArrow(run, schema)


def _sums(df: DataFrame, width: int) -> DataFrame:
    """(part, entry, position, total, n) of the vectors now in each entry; batches are summed before the shuffle."""
    part = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            x, code = _matrix(batch.column("x"), width).astype(np.int64), _matrix(batch.column("code"), PARTS)
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                held, first, n = np.unique(code[order, p], return_index=True, return_counts=True)
                total = np.add.reduceat(x[order, p * part : (p + 1) * part], first, axis=0)
                columns = [np.full(total.size, p), np.repeat(held, part), np.tile(np.arange(part), len(held)), total.ravel(), np.repeat(n, part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "position", "total", "n"]
                )

    made = df.select("x", "code").mapInArrow(run, "part bigint, entry bigint, position bigint, total bigint, n bigint")
    return made.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): components times 1024, rounded down; rows without a vector of finite numbers are dropped."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False))).select(
        "vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("bigint")).alias("x")
    )


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error), one row per row of vectors that is kept, and the codebooks.

    Vectors are cut into four parts. A part's codebook starts as that part of the
    256 vectors of the smallest ids (nulls last, equal ids by their components;
    all, if there are fewer). Every round assigns all parts, then moves each entry
    to the componentwise mean, rounded down; entries without parts stay. Parts are
    assigned again at the end. ``code`` is an array of four entries, ``error`` the
    squared distances summed over the parts, ``label_error`` the errors summed
    over equal labels, nulls together. Rows whose vector is missing or holds a
    missing or non-finite component are dropped; rows repeated come out as often.
    Vectors must be of one length that four divides, and small enough for exact
    64-bit distances; others are refused. Only vec_id, embedding and label are
    read. Each round reads the table of the round before, which is then deleted;
    the driver holds the codebooks and their sums only.
    """
    spark = vectors.sparkSession
    code = F.lit(None).cast(ArrayType(ShortType()))
    now, where = stored(whole_vectors(vectors).withColumn("code", code))
    if is_empty(now):
        return _finished(now.withColumn("error", F.lit(0).cast("bigint"))), Codebooks([])
    sizes = now.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    width = sizes["most"]
    if sizes["least"] != width or width % PARTS:
        raise ValueError("vectors must be of one length that the number of parts divides")
    first = now.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), width)
    books = Codebooks(np.split(start, PARTS, axis=1))
    for _ in range(rounds):
        after, path = stored(_assigned(now, books, width).drop("error"))
        discard(spark, where)
        now, where = after, path
        books = _moved_entries(books, _sums(now, width).collect())
    after, path = stored(_assigned(now, books, width).drop("x"))
    discard(spark, where)
    return _finished(after), books


def _moved_entries(books: Codebooks, sums: list) -> Codebooks:
    """Entries at the means of their parts, rounded down; entries without parts stay."""
    entries = [e.copy() for e in books.entries]
    for r in sums:  # one row for each component of the codebooks
        entries[r["part"]][r["entry"], r["position"]] = r["total"] // r["n"]
    return Codebooks(entries)


def _finished(coded: DataFrame) -> DataFrame:
    """With the error of each label, which is summed before it meets the rows."""
    coded = coded.select("vec_id", "label", "code", "error")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    if is_small(sums, ["__label"]):
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
