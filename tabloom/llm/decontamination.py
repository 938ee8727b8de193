"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Fixed masks over token positions; a zero is a position that may differ.
MASKS = ("1110110111", "1101011011", "11011100101", "10110101111")
#: Items of so many tokens or fewer, in which few replaced tokens break all of those masks, are searched for with shorter ones too.
SHORT_ITEM = 32
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: Items of fewer tokens than a short mask asks for are leaks only as they are.
TINY_MASKS = ("1", "11", "111")
#: A leak has so many matching tokens, or this share (a fraction) of a shorter item's.
LEAST_TOKENS = 13
SHARE = (4, 5)
#: Bytes of benchmark text searched for in one pass over the documents; a block's index is some thirty times as large.
BLOCK_BYTES = 4 << 20
#: Tokens whose seeds are looked up together, and cells of diagonals compared together.
_TOKENS = 1 << 18
_CELLS = 1 << 21
_WORD = re.compile(r"\w+")
#: Odd multipliers, one per mask position, from a fixed linear rule.
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) + 0x632BE59BD9B4E019 * k) % 2**64 | 1 for k in range(64)], dtype=np.uint64)


def tokens_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def needed(tokens: int) -> int:
    """Matching tokens that make a leak of an item of so many tokens."""
    return min(LEAST_TOKENS, -(-tokens * SHARE[0] // SHARE[1]))


@dataclass(frozen=True)
class Index:
    """Seeds of a block of benchmark items, as arrays: per mask the sorted hashes and where each occurs."""

    vocabulary: dict[str, int]
    names: list[list]
    tokens: np.ndarray
    begins: np.ndarray
    masks: list[np.ndarray]
    keys: list[np.ndarray]
    items: list[np.ndarray]
    offsets: list[np.ndarray]
    table: np.ndarray


def build(items: list[tuple]) -> Index:
    vocabulary: dict[str, int] = {}
    same: dict[bytes, list] = {}  # items of the same tokens are searched for once
    for item, text in items:
        ids = [vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens_of(text)]
        if ids:
            same.setdefault(np.array(ids, dtype=np.uint64).tobytes(), []).append(item)
    names, coded = list(same.values()), [np.frombuffer(ids, dtype=np.uint64) for ids in same]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    tokens = np.concatenate([*coded, np.zeros(0, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(coded)), sizes)
    place, size = np.arange(len(tokens)) - begins[owner], sizes[owner]
    masks, keys, at, offsets = [], [], [], []
    for text in (*MASKS, *SHORT_MASKS, *TINY_MASKS):
        fits = place + len(text) <= size
        if text in TINY_MASKS:
            fits &= size == len(text)
        elif text in SHORT_MASKS:
            fits &= size <= SHORT_ITEM
        fits = np.nonzero(fits)[0]
        if not len(fits):
            continue
        mask = np.array([i for i, c in enumerate(text) if c == "1"])
        found = _seeds(tokens, mask)[fits]
        order = np.argsort(found, kind="stable")
        masks.append(mask)
        keys.append(found[order])
        at.append(owner[fits][order])
        offsets.append(place[fits][order])
    seeds = np.concatenate([*keys, np.zeros(0, dtype=np.uint64)])
    bits = max(10, len(seeds).bit_length() + 3)
    table = np.zeros(1 << bits, dtype=bool)
    table[seeds >> np.uint64(64 - bits)] = True
    return Index(vocabulary, names, tokens, begins, masks, keys, at, offsets, table)


def _seeds(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hash of the masked tokens at every position where the mask fits."""
    n = len(ids) - int(mask[-1])
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    for k, p in enumerate(mask):
        out += ids[p : p + n] * _MIX[k]
        out ^= out >> np.uint64(29)
        out *= _MIX[k + 16]
    return out


def _diagonals(ids: np.ndarray, begins: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (item, text, shift) of all seed hits, in order; shift is where the item would begin in the text."""
    unused = np.uint64(64 - (len(index.table).bit_length() - 1))
    longest, found = len(index.tokens), [np.zeros(0, dtype=np.int64)]
    span = len(ids) + longest  # shifts lie between -longest and the number of tokens
    for number, (mask, keys) in enumerate(zip(index.masks, index.keys)):
        seeds = _seeds(ids, mask)
        hit = np.nonzero(index.table[seeds >> unused])[0]
        low = np.searchsorted(keys, seeds[hit], side="left")
        count = np.searchsorted(keys, seeds[hit], side="right") - low
        # every occurrence of the seed in the items
        entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        hit = np.repeat(hit, count)
        text = np.searchsorted(begins, hit, side="right") - 1
        shift = hit - begins[text] - index.offsets[number][entry]
        found.append(np.unique((index.items[number][entry] * len(begins) + text) * span + shift + longest))
    pair, shift = np.divmod(np.unique(np.concatenate(found)), span)
    return np.stack([pair // len(begins), pair % len(begins), shift - longest], 1)


def window_of(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(matches, first, end) of the window with the most matches, the earliest of equals, if any qualifies.

    A window qualifies with ``least`` matches or more that make up the share of
    its tokens. It begins and ends with a match, say the p-th and the q-th; with
    their places, the share a / b holds if f(q) = b (q + 1) - a (place + 1) is not
    below g(p) = b p - a place. So the first p whose running minimum of g is not
    above f(q) gives the longest window that ends in q.
    """
    places = np.nonzero(same)[0]
    if len(places) < least:
        return None
    a, b = SHARE
    number = np.arange(len(places))
    begin = np.minimum.accumulate(b * number - a * places)
    first = np.searchsorted(-begin, -(b * (number + 1) - a * (places + 1)), side="left")
    count = number - first + 1
    q = int(np.argmax(count))
    return (int(count[q]), int(places[first[q]]), int(places[q]) + 1) if count[q] >= least else None


def _found(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, index: Index) -> dict[tuple[int, int], tuple]:
    """The best window of each (text, item): matches, less the first token, the end.

    A diagonal is compared as a whole first; only one with enough matches in all is
    looked at window by window, and none that cannot beat the best so far.
    """
    best: dict[tuple[int, int], tuple] = {}
    diagonals = _diagonals(ids, begins, index)
    cuts = np.searchsorted(diagonals[:, 0], np.arange(len(index.names) + 1))
    for item in np.nonzero(np.diff(cuts))[0].tolist():
        want = index.tokens[index.begins[item] : index.begins[item + 1]]
        least, step = needed(len(want)), max(1, _CELLS // len(want))
        for k in range(cuts[item], cuts[item + 1], step):
            _, text, shift = diagonals[k : min(k + step, cuts[item + 1])].T
            place = shift[:, None] + np.arange(len(want))
            inside = (place >= 0) & (place < lengths[text][:, None])
            same = inside & (ids[np.where(inside, begins[text][:, None] + place, 0)] == want)
            total = same.sum(1)
            for r in np.argsort(-total, kind="stable").tolist():
                if total[r] < least:
                    break
                key = (int(text[r]), item)
                known = best.get(key)
                if known and (total[r] < known[0] or total[r] == known[0] and shift[r] >= -known[1]):
                    continue
                window = window_of(same[r], least)
                if window:
                    found = (window[0], -int(shift[r]) - window[1], int(shift[r]) + window[2])
                    best[key] = max(found, known or found)
    return best


def found_in(texts, index: Index) -> Iterator[tuple[int, list[tuple]]]:
    """(number of the text, its leaks as in ``leaks``) for every text that has any.

    Texts are looked up together, up to a bounded number of tokens or one longer text.
    """
    # zeros between texts, which are no token of an item
    gap = np.zeros(max((int(m[-1]) for m in index.masks), default=0), dtype=np.uint64)
    held, begins, lengths, numbers, size = [], [], [], [], 0

    def flush() -> Iterator[tuple[int, list[tuple]]]:
        out: dict[int, list[tuple]] = {}
        if held:
            best = _found(np.concatenate(held), np.array(begins), np.array(lengths), index)
            for (text, item), (n, start, end) in sorted(best.items()):
                count = int(index.begins[item + 1] - index.begins[item])
                out.setdefault(numbers[text], []).extend((name, n, count, -start, end) for name in index.names[item])
        yield from out.items()

    get = index.vocabulary.get
    for number, text in enumerate(texts):
        ids = np.array([get(t, 0) for t in tokens_of(text)], dtype=np.uint64)
        if not ids.any():
            continue
        if held and size + len(ids) > _TOKENS:
            yield from flush()
            held, begins, lengths, numbers, size = [], [], [], [], 0
        begins.append(size)
        lengths.append(len(ids))
        numbers.append(number)
        held += [ids, gap]
        size += len(ids) + len(gap)
    yield from flush()


def leaks(text: str | None, index: Index) -> list[tuple]:
    """(item, matching tokens, tokens of the item, first and last token + 1 here), the best window of each item.

    Every seed hit names a diagonal, on which the text and the item are compared
    token by token. The item leaks if any window of the diagonal has enough
    matching tokens that make up the stated share of the window.
    """
    return next((found for _, found in found_in([text], index)), [])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Distinct benchmark rows in blocks of bounded size, one held at a time."""
    benchmark = benchmark.select("item_id", "text").distinct()
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in benchmark.filter(part == b).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, matched, item_tokens, first_token, end_token), one per document row and item it holds.

    The documents are read once per block of the benchmark; nothing is shuffled.
    Missing and empty texts hold nothing, and items without a token are held by
    nothing; items of null id are searched for too. Items equal in id and text are
    one item; rows of documents that repeat are reported each.
    """
    names = ["matched", "item_tokens", "first_token", "end_token"]
    schema = StructType([docs.schema["doc_id"], StructField("item_id", LongType()), *[StructField(c, IntegerType()) for c in names]])

    def of(items: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(build(items))  # one block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = (x.as_py() for x in batch.column("text"))
                rows = [(number, *leak) for number, found in found_in(texts, sent.value) for leak in found]
                columns = list(zip(*rows)) or [()] * 6
                ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
                rest = [pa.array(c, pa.int32()) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int64()), *rest], names=schema.names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.union, [of(items) for items in _blocks(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that hold no benchmark item; all columns as they were.

    Rows with a missing or empty text stay, and so do repeated rows, each of them,
    unless they hold an item.
    """
    for items in _blocks(benchmark):
        docs = docs.filter(_holds_none(docs.sparkSession, items)("text"))
    return docs


def _holds_none(spark: SparkSession, items: list[tuple]) -> Callable[[str], Column]:
    sent = spark.sparkContext.broadcast(build(items))  # one block

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = np.ones(len(batch), dtype=bool)
            out[[number for number, _ in found_in(batch, sent.value)]] = False
            yield pd.Series(out)

    return F.pandas_udf(clean, "boolean")
