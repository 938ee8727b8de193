"""Ranked lexical search: exact top documents by accumulator-limited term-at-a-time evaluation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tabloom.llm.common import durable

#: Documents returned for each item.
TOP = 20
#: Bytes of item text searched for in one pass over the documents; bounds the vocabulary that is sent out.
BLOCK_BYTES = 1 << 20
#: Documents and postings searched together in a task, at most.
TASK_DOCUMENTS = 65_536
TASK_POSTINGS = 1 << 22
#: A term, in UTF-8 after ASCII letters were lower-cased: all bytes beyond ASCII belong to terms.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: bytes | str | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters; only A-Z are lower-cased."""
    if text is None:
        return []
    return _TERM.findall((text.encode() if isinstance(text, str) else text).lower())


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _blocks(items: DataFrame) -> Iterator[list]:
    """Distinct items in blocks of bounded size, one held at a time."""
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield items.filter(part == b).collect()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times): terms of a document with repeats, and those of the vocabulary it holds, by number.

    Documents without a term are left out. The vocabulary comes from one block of items.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    listed = [StructField(c, ArrayType(IntegerType())) for c in ("terms", "times")]
    schema = StructType([docs.schema["doc_id"], StructField("n", LongType()), *listed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, kept, terms, times, offsets = [], [], [], [], [0]
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):  # one text at a time
                found = terms_of(texts[i].as_py())
                if not found:
                    continue
                held = Counter(found)
                both = [t for t in held if t in known] if len(held) < len(known) else [t for t in known if t in held]
                sizes.append(len(found))
                kept.append(i)
                terms += [known[t] for t in both]
                times += [held[t] for t in both]
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Inverted:
    """Postings of some documents by term: documents in order, and what a term's occurrences there score per weight."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, size: int, documents: int, words: int):
        m = 100 - 25 + (25 * n * documents) // words
        doc = np.repeat(np.arange(len(n)), lengths)
        tf = times.astype(np.int64)
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.count = len(n)
        self.doc, self.part = doc[order], part[order]
        self.cuts = np.searchsorted(terms[order], np.arange(size + 1))
        self.best = np.zeros(size, dtype=np.int64)
        held = np.nonzero(np.diff(self.cuts))[0]
        if len(held):
            self.best[held] = np.maximum.reduceat(self.part, self.cuts[held])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[self.cuts[term] : self.cuts[term + 1]], self.part[self.cuts[term] : self.cuts[term + 1]]


def search_block(inverted: Inverted, query: list[tuple[int, int]], floor: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the top and their exact scores, all of ``floor`` and above 0.

    ``query`` has (term, weight times repeats), rarest first; ``floor`` is a score
    that the top are known to reach. Accumulators are made while a document not
    seen so far could still reach the larger of ``floor`` and the k-th partial
    score by what the remaining terms give at most; equal scores count as reached,
    as the smaller id wins. From then on only documents with accumulators are
    updated, exactly, and those that cannot reach it any more are let go.
    """
    bounds = np.array([w * int(inverted.best[t]) for t, w in query], dtype=np.int64)
    left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
    sums, at = np.zeros(inverted.count, dtype=np.int64), 0
    while at < len(query):
        if left[at] < floor or at and left[at] < sums.max() and left[at] < _kth(sums, top):
            break
        docs, part = inverted.of(query[at][0])
        sums[docs] += query[at][1] * part
        at += 1
    alive = np.nonzero(sums)[0]
    scores = sums[alive]
    while at < len(query):
        least = max(floor, _kth(scores, top))
        able = scores + left[at] >= least
        alive, scores = alive[able], scores[able]
        docs, part = inverted.of(query[at][0])
        if len(docs) and len(alive):
            place = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            met = docs[place] == alive
            scores[met] += query[at][1] * part[place[met]]
        at += 1
    least = max(floor, _kth(scores, top), 1)
    return alive[scores >= least], scores[scores >= least]


def _kth(scores: np.ndarray, top: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        more = len(batch.column("terms").flatten())
        if held and (rows + batch.num_rows > TASK_DOCUMENTS or size + more > TASK_POSTINGS):
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
        held.append(batch)
        rows += batch.num_rows
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _searched(table: DataFrame, queries: list[list[tuple[int, int]]], size: int, documents: int, words: int, top: int) -> DataFrame:
    """(item, doc_id, score) of the top documents of every chunk of a task that can still be among the top.

    Scores that the task has found so far are the floor of its next chunk.
    """
    sent = table.sparkSession.sparkContext.broadcast(queries)
    schema = StructType([StructField("item", IntegerType()), table.schema["doc_id"], StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, dtype=np.int64) for _ in sent.value]
        for chunk in _chunks(batches):
            chunk = chunk.to_batches()[0]
            lists = chunk.column("terms")
            lengths = np.diff(lists.offsets.to_numpy())
            inverted = Inverted(
                chunk.column("n").to_numpy(), lengths, lists.flatten().to_numpy(), chunk.column("times").flatten().to_numpy(),
                size, documents, words,
            )
            items, rows, scores = [], [], []
            for item, query in enumerate(sent.value):
                found, score = search_block(inverted, query, _kth(seen[item], top), top)
                if len(found) > top:  # equal scores beyond the top: smaller ids first
                    ids = chunk.column("doc_id").take(pa.array(found))
                    order = pc.sort_indices(
                        pa.table({"score": score, "id": ids}), sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end"
                    ).to_numpy()[:top]
                    found, score = found[order], score[order]
                seen[item] = np.sort(np.concatenate([seen[item], score]))[-top:]
                items.append(np.full(len(found), item, dtype=np.int32))
                rows.append(found)
                scores.append(score)
            if not items:
                continue
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(items)), chunk.column("doc_id").take(pa.array(at, pa.int64())), pa.array(np.concatenate(scores))],
                names=["item", "doc_id", "score"],
            )

    return table.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the highest-scoring documents of every item, equal scores by ascending id.

    docs has doc_id and text, items have item_id and text; other columns are not
    read. Documents without a term (missing or empty texts) do not count and are
    never found; items without one find nothing. Rows of documents that repeat are
    documents of their own; ids that are missing come last among equal scores.
    Rows of items equal in id and text are one item; items that share an id but
    not a text are ranked each.

    Items are searched for in blocks of bounded size; for each the documents are
    read once and leave the terms that the block asks for. Every task ranks its
    own documents; what it returns, at most the top for each item and chunk, is
    ranked again. A document's score needs nothing of other documents but the
    counts, so common terms, large groups of copies and uneven partitions do not
    meet in one task.
    """
    out = [_search_block_of(docs, block, items, top) for block in _blocks(items)]
    return reduce(DataFrame.union, out)


def _search_block_of(docs: DataFrame, block: list, items: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [Counter(terms_of(r["text"])) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}))}
    table = durable(postings(docs, vocabulary))
    totals = table.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    held = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = {r["term"]: r["df"] for r in held.collect()}  # the block's terms at most
    queries = []
    for a in asked:
        known = sorted((df[vocabulary[t]], vocabulary[t], times) for t, times in a.items() if vocabulary[t] in df)
        queries.append([(t, times * weight(totals["documents"], n)) for n, t, times in known])
    found = _searched(table, queries, len(vocabulary), totals["documents"], totals["words"], top)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    kind = StructType([StructField("item", IntegerType()), items.schema["item_id"]])
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], kind)  # one block
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
