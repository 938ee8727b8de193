"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import durable, row_key
from tabloom.llm.components import components

#: Fingerprints in one tile, at most about; a tile pair is one unit of work.
TILE = 16_384
#: Bands of neighbouring population counts; their pairs are listed on the driver.
BANDS = 256
_BAND_ROWS = 2_048
_QUARTERS = (48, 32, 16, 0)
_BLOCK = 256
_BITS_AT_ONCE = 65_536


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """64 majority bits over the XXH64 of word shingles, as a signed number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), _BITS_AT_ONCE):
        some = values[at : at + _BITS_AT_ONCE]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprint(text: str | Column, shingle: int = 4) -> Column:
    """Fingerprint column; a text without words, or no text, has fingerprint 0."""
    return F.udf(lambda t: fingerprint_of(t, shingle), "bigint")(text)


def links_between(a: list[int], b: list[int], same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the fingerprints of two tiles that differ in at most ``radius`` bits.

    Tiles are sorted by the population counts of their 16-bit quarters and cut
    into blocks; block pairs whose counts differ by more than the radius in sum
    are skipped. Only links that join two trees are kept, so a large group of
    near copies gives as many links as it has members, not their square.
    """
    left, left_box = _blocks(a)
    right, right_box = (left, left_box) if same else _blocks(b)
    nodes = np.concatenate([left, right])
    tree = np.arange(len(nodes))
    if same:
        tree[len(left) :] = tree[: len(left)]
    gap = np.maximum(left_box[:, None, 0] - right_box[None, :, 1], right_box[None, :, 0] - left_box[:, None, 1])
    near = np.maximum(gap, 0).sum(axis=2) <= radius
    for i, j in zip(*np.nonzero(near)):
        if same and j < i:
            continue
        x, y = left[i * _BLOCK : (i + 1) * _BLOCK], right[j * _BLOCK : (j + 1) * _BLOCK]
        p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
        if len(p):
            _unite(tree, p + i * _BLOCK, q + j * _BLOCK + len(left))
    signed = nodes.view(np.int64)
    root = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(root, tree, signed)
    found = root[tree]
    apart = np.nonzero(found != signed)[0]
    return [(int(signed[k]), int(found[k])) for k in apart if not (same and k >= len(left))]


def _blocks(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values in the order of their quarter counts, and (block, least / most, quarter) counts."""
    v = np.array(values, dtype=np.int64).view(np.uint64)
    counts = np.stack([np.bitwise_count((v >> np.uint64(s)) & np.uint64(0xFFFF)) for s in _QUARTERS], axis=1).astype(np.int64)
    order = np.lexsort(counts.T[::-1])
    v, counts = v[order], counts[order]
    cuts = range(0, len(v), _BLOCK)
    return v, np.array([[counts[c : c + _BLOCK].min(axis=0), counts[c : c + _BLOCK].max(axis=0)] for c in cuts])


def _unite(tree: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the trees of the pairs (p, q) in place; tree[k] is always a root."""
    while True:
        a, b = tree[p], tree[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(tree, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = tree[tree]
            if (up == tree).all():
                break
            tree[:] = up


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits.

    Every pair of tiles whose population counts allow a link is compared in
    full. Tiles are hash parts of bands of equal or neighbouring counts; a band
    layout needs only the row count of each combination of quarter counts, of
    which there are 17^4 at most, whatever the corpus.
    """
    spark = prints.sparkSession
    quarters = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))) for s in _QUARTERS]
    cell = sum((q * F.lit(32**k) for k, q in enumerate(reversed(quarters))), F.lit(0))
    celled = prints.select("fp", cell.cast("int").alias("cell"))
    counts = sorted((r["cell"], r["count"]) for r in celled.groupBy("cell").count().collect())
    bands, pairs = _layout(counts, radius)
    band_of = spark.createDataFrame(bands, "cell int, band int, parts int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = (
        celled.join(F.broadcast(band_of), "cell")
        .groupBy("band", part.alias("part"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    tiles = durable(tiles)
    meets = spark.createDataFrame(pairs, "band int, other int, other_parts int")
    work = (
        tiles.join(F.broadcast(meets), "band")
        .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
        .filter("band < other or part <= other_part")
    )
    # comparison time, not bytes, sizes the tasks: small inputs would be merged into one
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = min(20_000, max(2 * parallel, len(pairs) // 16))
    other = tiles.select(F.col("band").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("other_fps"))
    compare = F.udf(
        lambda a, b, same: links_between(a, b, same, radius), "array<struct<a:bigint,b:bigint>>"
    )
    same = (F.col("band") == F.col("other")) & (F.col("part") == F.col("other_part"))
    met = work.repartition(spread, "other", "other_part").join(other, ["other", "other_part"])
    return met.select(F.inline(compare("fps", "other_fps", same)))


def _layout(counts: list[tuple[int, int]], radius: int) -> tuple[list, list]:
    """Bands of neighbouring cells, and the band pairs whose counts can lie within the radius."""
    total = sum(n for _, n in counts)
    room = max(_BAND_ROWS, -(-total // BANDS))
    band, boxes, sizes, filled = [], [], [], room
    for cell, n in counts:
        q = np.array([cell >> 15, cell >> 10 & 31, cell >> 5 & 31, cell & 31])
        if filled and filled + n > room:
            boxes.append([q, q])
            sizes.append(0)
            filled = 0
        boxes[-1] = [np.minimum(boxes[-1][0], q), np.maximum(boxes[-1][1], q)]
        filled += n
        sizes[-1] += n
        band.append((cell, len(boxes) - 1))
    parts = [max(1, -(-n // TILE)) for n in sizes]
    box = np.array(boxes).reshape(-1, 2, 4)
    gap = np.maximum(box[:, None, 0] - box[None, :, 1], box[None, :, 0] - box[:, None, 1])
    near = np.triu(np.maximum(gap, 0).sum(axis=2) <= radius)
    pairs = [(int(i), int(j), parts[j]) for i, j in zip(*np.nonzero(near))]
    return [(c, b, parts[b]) for c, b in band], pairs


def near_duplicates(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` reachable over links, to (doc_id, fp, ...).

    ``prints`` is read several times: pass a checkpointed or stored frame. Equal
    fingerprints are one node, so exact copies cost nothing. Null ids take part;
    a component of null ids only has component_id null. No rows give no rows.
    """
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(smallest, "root").select("fp", "component_id", F.col("root").alias("component"))
    return prints.join(durable(linked), "fp", "left")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null ids come last; rows equal in id and text stay once. Other columns are
    passed through, whatever their names.
    """
    prints = durable(docs.select("doc_id", fingerprint("text", shingle).alias("fp"), *row_key(F.col("doc_id"), F.col("text"))))
    grouped = near_duplicates(prints, radius)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k1", "__k2")
    kept = grouped.groupBy("component").agg(F.min(order).alias("o")).select("o.__k1", "o.__k2")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *row_key(F.col("doc_id"), F.col("text")))
    once = keyed.join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return once.select("d.*")
