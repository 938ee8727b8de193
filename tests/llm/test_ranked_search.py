import math
import random
import re
from collections import Counter

import numpy as np

from tabloom.llm import ranked_search as rs

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def _terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _brute(docs, items, top=20):
    held = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs if _terms(t)]
    total, n_docs = sum(n for _, _, n in held), len(held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for at, (i, c, n) in enumerate(held):
            m = 75 + (25 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w in _terms(text) if c[w]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def _case():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    pick = lambda n: " ".join(rnd.choices(words, weights, k=n))
    docs = [(i, pick(rnd.randint(1, 80))) for i in range(400)]
    docs += [(1000 + i, "w3 W3, w40 w7-w7") for i in range(90)]  # a group of copies, larger than the top
    docs += [(5, "w3 w40"), (5, "w3 w40"), (None, "w40 w40"), (None, None), (600, None), (601, ""), (602, " ...\n"), (603, "K w40 Ünder ünder É"),
             (604, "w1 " * 30_000 + "w59")]
    items = [(i, pick(rnd.randint(1, 25))) for i in range(25)]
    items += [(30, "w3 w40 w40"), (31, None), (32, ""), (33, "nowhere"), (30, "w7"), (30, "w7"), (None, "w59 W58"), (34, "Ünder ünder É K")]
    rnd.shuffle(docs)
    return docs, items


def test_against_brute_force(spark):
    docs, items = _case()
    want = _brute(docs, items)
    for parts in (1, 7, 40):
        df = spark.createDataFrame(docs, DOCS).repartition(parts)
        got = [tuple(r) for r in rs.search(df, spark.createDataFrame(items, ITEMS)).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=repr) == want
    got = rs.search(df, spark.createDataFrame(items, ITEMS), top=3).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(docs, items, 3)


def test_items_in_blocks(spark, monkeypatch):
    docs, items = _case()
    monkeypatch.setattr(rs, "BLOCK_BYTES", 400)
    got = rs.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == _brute(docs, items)


def test_accumulators_stop_and_survivors_stay_exact():
    rnd = np.random.default_rng(2)
    n_docs, size = 3000, 12
    held = rnd.random((n_docs, size)) < np.linspace(0.01, 0.9, size)
    times = rnd.integers(1, 6, (n_docs, size)) * held
    lengths, terms = held.sum(1), np.nonzero(held)[1]
    n = times.sum(1) + 1
    inverted = rs.Inverted(n, lengths, terms, times[held], size, n_docs, int(n.sum()))
    query = [(t, rs.weight(n_docs, int(held[:, t].sum()))) for t in range(size)]
    m = 75 + (25 * n * n_docs) // int(n.sum())
    whole = sum(w * ((10**9 * times[:, t]) // (1000 * times[:, t] + 12 * m)) for t, w in query)
    kth = int(np.sort(whole)[-20])
    for floor in (0, kth, int(whole.max()), int(whole.max()) + 1):
        found, scores = rs.search_block(inverted, query, floor)
        assert found.tolist() == np.nonzero(whole >= max(kth, floor))[0].tolist()
        assert (scores == whole[found]).all()


def test_empty_tables_and_other_columns(spark):
    empty, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert rs.search(empty, items).count() == 0
    assert rs.search(spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 4, "x", 9), (2, "c", 4, "x", 9)], DOCS + ", score int, rank string, n int")
    assert [(r.item_id, r.rank, r.doc_id) for r in rs.search(clash, items).collect()] == [(1, 1, 1)]
