"""Token counts from pieces counted once per distinct pre-token."""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import durable, row_key

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a task holds before it hands its counts on.
HELD = 200_000
#: Pre-tokens encoded at a time.
ENCODED_AT_ONCE = 1_000
#: Rows handed on at a time.
ROWS_AT_ONCE = 20_000
#: A frequent pre-token is one of so many occurrences; fewer, if those pass the bounds below.
ONE_IN = 4_000_000
#: At most so many frequent pre-tokens, of so many bytes together, are sent to every task.
FREQUENT_ROWS = 500_000
FREQUENT_BYTES = 16 << 20


@lru_cache(1)
def disputed() -> frozenset[str]:
    """Characters that the two libraries' versions of Unicode may class differently: those Python does not know yet."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn")


def pre_tokens(path: str) -> Callable[[str], tuple[list[str], int]]:
    """A function from a text to its pre-tokens and the number of special tokens in it."""
    from tokenizers import Tokenizer

    find, odd, specials = regex.compile(PATTERN).findall, disputed(), specials_of(path)
    own = Tokenizer.from_file(path).pre_tokenizer
    high = re.compile(f"[{min(odd)}-\U0010ffff]").search if odd else lambda text: None
    apart = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) or "(?!)")

    def pieces(text: str) -> list[str]:
        if text.isascii() or not high(text) or odd.isdisjoint(text):
            return find(text)
        return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]

    def split(text: str) -> tuple[list[str], int]:
        if not any(s in text for s in specials):
            return pieces(text), 0
        parts = apart.split(text)
        return [t for p in parts for t in pieces(p)], len(parts) - 1

    return split


def specials_of(path: str) -> list[str]:
    """Special strings that the library finds inside texts; others than plain ones are refused."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_added_tokens_decoder().values()
    odd = [t.content for t in found if t.lstrip or t.rstrip or t.single_word or t.normalized]
    if odd:
        raise ValueError(f"added tokens with options are not supported: {odd}")
    return [t.content for t in found]


def distinct_pre_tokens(texts: DataFrame, path: str) -> DataFrame:
    """(piece, n): every distinct pre-token of the column ``text`` and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = pre_tokens(path), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py())[0])
                if len(seen) >= HELD:
                    yield _pairs(seen)
                    seen = Counter()
        yield _pairs(seen)

    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "piece string, n bigint")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def _pairs(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"]
    )


def with_lengths(distinct: DataFrame, path: str) -> DataFrame:
    """Add ``tokens``, the number of tokens of each pre-token, from the library itself."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            tokens = []
            for at in range(0, batch.num_rows, ENCODED_AT_ONCE):
                pieces = batch.column(0).slice(at, ENCODED_AT_ONCE).to_pylist()
                tokens += [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["piece", "n", "tokens"]
            )

    return distinct.select("piece", "n").mapInArrow(lengths, "piece string, n bigint, tokens bigint")


def _frequent(lengths: DataFrame) -> Column:
    """Whether a pre-token is frequent; the frequent ones' rows and bytes are measured against their bounds."""
    total, one_in = lengths.agg(F.sum("n")).first()[0] or 0, ONE_IN
    while True:
        often = F.col("n") * one_in > total
        rows, size = lengths.filter(often).agg(F.count("*"), F.sum(F.octet_length("piece"))).first()
        if rows <= FREQUENT_ROWS and (size or 0) <= FREQUENT_BYTES:
            return often
        one_in //= 2


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """All rows of docs with ``n_bytes`` and ``n_tokens`` of the column ``text``.

    Counts agree with encoding whole texts without begin, end or other added
    tokens; special strings inside a text count as one. A missing text is empty.
    Frequent pre-tokens, a table of bounded size, are looked up where a document
    is read; the others are joined by shuffle. No ids are made. Rows equal in every column are counted
    together and come out as often as they were.
    """
    spark = docs.sparkSession
    lengths = durable(with_lengths(distinct_pre_tokens(docs.select("text"), path), path))
    often = _frequent(lengths)
    known = spark.sparkContext.broadcast(dict(lengths.filter(often).select("piece", "tokens").toPandas().values.tolist()))
    rare = lengths.filter(~often).select(F.col("piece").alias("name"), "tokens")

    names = ["__k1", "__k2", "piece", "times"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64()]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, get = pre_tokens(path), known.value.get
        out: tuple[list, ...] = ([], [], [], [])

        def add(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, text in enumerate(batch.column(2)):
                found, tokens = split(text.as_py())
                for piece, n in Counter(found).items():
                    one = get(piece)
                    if one is None:
                        add(a[at], b[at], piece, n)
                    else:
                        tokens += one * n
                add(a[at], b[at], None, tokens)
                if len(out[0]) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    out = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    whole = F.coalesce("text", F.lit(""))
    # 96 bits stand for the values of a row
    k1, k2 = row_key(*[F.col(f"`{c}`") for c in keep])
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__d"), k1, k2, whole.alias("__text")
    ).withColumn("__k2", F.hash("__k2"))
    tallied = keyed.select("__k1", "__k2", "__text").mapInArrow(tally, "__k1 bigint, __k2 int, piece string, times bigint")
    # a document's own row has no piece; it gets a name of its own so that such rows do not meet in one task
    name = F.coalesce("piece", F.concat_ws(" ", F.lit("\x00"), "__k1", "__k2"))
    per_row = (
        tallied.select("__k1", "__k2", name.alias("name"), "times")
        .join(rare, "name", "left")
        .groupBy("__k1", "__k2")
        .agg(
            F.sum(F.col("times") * F.coalesce("tokens", F.lit(1))).alias("all"),
            F.count_if(F.col("tokens").isNull()).alias("rows"),
        )
        .select("__k1", "__k2", F.expr("`all` div rows").alias("n_tokens"))
    )
    sized = keyed.select("__d", "__k1", "__k2", F.octet_length("__text").cast("bigint").alias("n_bytes"))
    return sized.join(per_row, ["__k1", "__k2"]).select("__d.*", "n_bytes", "n_tokens")
