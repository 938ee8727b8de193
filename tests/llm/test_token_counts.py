import sys
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabloom.llm import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def _library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(e) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXTS = [
    "", None, " ", "  a", "\n\n \tb  ", "It's we've I'M 'sx !'s", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "é 𝒳 漢字 ١٢ ①",
    "x" * 5000, "a b " * 30_000, "  z​", "\x00 1 2", "0\x00 5",
]


@pytest.mark.parametrize("one_in", [1, 300, 4_000_000])
def test_against_the_library(spark, monkeypatch, one_in):
    monkeypatch.setattr(token_counts, "ONE_IN", one_in)  # all, some or no pre-tokens are joined
    monkeypatch.setattr(token_counts, "HELD", 7)
    sf = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = TEXTS + sf
    rows = [(i if i % 13 else None, t, "m") for i, t in enumerate(texts)] + [(1, "twice or", "m")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = token_counts.count_tokens(df, PATH).collect()
    want = sorted((str(r[0]), r[1] or "", len((r[1] or "").encode()), n) for r, n in zip(rows, _library([r[1] for r in rows])))
    assert sorted((str(r["doc_id"]), r["text"] or "", r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_pre_tokens_of_every_character():
    """The pattern's classes are those of the library, character by character."""
    split = token_counts.pre_tokens(PATH)
    own = Tokenizer.from_file(PATH).pre_tokenizer
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) != "Cs"]
    texts = [f"a{c}1{c}!" for c in every]
    assert [t for t in texts if len(own.pre_tokenize_str(t)) != len(split(t)[0])] == []


def test_missing_text_differs_from_a_nul(spark):
    texts = [None, "\x00", None, "", "\x00\x00"]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id bigint, text string")
    got = sorted((r.text is None, r.text or "", r.n_tokens) for r in token_counts.count_tokens(df.withColumn("t", df.text), PATH).selectExpr("t as text", "n_tokens").collect())
    assert got == sorted((t is None, t or "", n) for t, n in zip(texts, _library(texts)))
