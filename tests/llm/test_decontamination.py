import random
import time
from itertools import combinations

import numpy as np

from tabloom.llm import decontamination as d


def _window(same, need):
    """Whether any window has so many matches that make up four fifths of it."""
    sums = [0]
    for x in same:
        sums.append(sums[-1] + x)
    return any(sums[j] - sums[i] >= max(need, 0.8 * (j - i)) for i in range(len(same)) for j in range(i + need, len(same) + 1))


def _brute(text, items):
    """Items of which any window on some diagonal has enough matching tokens at the stated share."""
    words, found = d.tokens_of(text), set()
    for item, t in items:
        want = d.tokens_of(t)
        need = min(d.LEAST_TOKENS, -(-len(want) * 4 // 5))
        for shift in range(-len(want) + 1, len(words)):
            same = [0 <= i + shift < len(words) and words[i + shift] == want[i] for i in range(len(want))]
            if want and sum(same) >= need and _window(same, need):
                found.add(item)
    return found


def _case():
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([6, 9, 14, 30, 60])))) for i in range(40)] + [(40, "too short"), (None, " ".join(text(20))), (41, None), (42, "")]
    docs = []
    for i in range(150):
        words = text(rnd.randint(0, 120))
        kind = i % 5
        if kind:
            part = d.tokens_of(rnd.choice(items[:40])[1])
            if kind == 2:  # a few words replaced
                for k in range(7, len(part), 11):
                    part[k] = "other"
            if kind == 3:  # a passage of it
                part = part[len(part) // 4 :]
            if kind == 4:
                part = [p.upper() + "," for p in part]
            at = rnd.randint(0, len(words))
            words[at:at] = part
        docs.append((i, "  ".join(words)))
    return items, docs


def test_against_brute_force(spark):
    items, docs = _case()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, items[3][1])], "doc_id bigint, text string")
    got = {}
    for r in d.contaminated(df, bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    want = {i: f for i, t in docs if (f := _brute(t, items))}
    want[None] = _brute(items[3][1], items)
    extra = {i: got[i] - want.get(i, set()) for i in got if got[i] - want.get(i, set())}
    missed = [(i, x) for i in want for x in want[i] - got.get(i, set())]
    assert not extra
    # a stretch without any window that a mask forgives may be passed over
    assert len(missed) <= 0.02 * sum(map(len, want.values())), missed
    exact = [i for i, _ in docs if i % 5 in (1, 4)]
    assert not [m for m in missed if m[0] in exact]


def test_blocks_and_stage(spark, monkeypatch):
    items, docs = _case()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    whole = sorted(map(tuple, d.contaminated(df, bench).collect()), key=str)
    monkeypatch.setattr(d, "BLOCK_BYTES", 2_000)
    assert sorted(map(tuple, d.contaminated(df, bench).collect()), key=str) == whole
    kept = d.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {r[0] for r in whole}
    assert d.contaminated(df.limit(0), bench).count() == 0
    assert d.without_leaks(df, bench.limit(0)).count() == len(docs)


def test_window_against_all_windows():
    rnd = random.Random(1)
    for _ in range(3000):
        same = [rnd.random() < 0.8 for _ in range(rnd.randint(1, 40))]
        need = rnd.randint(1, 14)
        windows = [
            (sum(same[i:j]), -i, j) for i in range(len(same)) for j in range(i + 1, len(same) + 1)
            if same[i] and same[j - 1] and sum(same[i:j]) >= need and 5 * sum(same[i:j]) >= 4 * (j - i)
        ]
        got = d.window_of(np.array(same), need)
        if not windows:
            assert got is None
        else:
            n, begin, end = got
            assert (n, -begin, end) in windows and n == max(windows)[0]


def test_short_items_with_any_tokens_replaced_that_the_rule_accepts():
    for size in range(1, 18):
        item = [f"t{i}" for i in range(size)]
        index = d.build([(1, " ".join(item))])
        for gone in combinations(range(size), size - d.needed(size)):
            same = [i not in gone for i in range(size)]
            words = ["x"] * 5 + [w if s else "z" for w, s in zip(item, same)] + ["y"] * 5
            assert bool(d.leaks(" ".join(words), index)) == _window(same, d.needed(size)), (size, gone)


def test_recall_of_longer_items():
    rnd = random.Random(2)
    for size in range(18, 31):
        item = [f"t{i}" for i in range(size)]
        index = d.build([(1, " ".join(item))])
        for gone in range(1, 7):
            held = [sorted(rnd.sample(range(size), gone)) for _ in range(300)]
            cases = [[i not in g for i in range(size)] for g in held]
            cases = [c for c in cases if _window(c, d.needed(size))]
            found = sum(bool(d.leaks(" ".join(w if s else "z" for w, s in zip(item, c)), index)) for c in cases)
            assert found >= 0.95 * len(cases), (size, gone, found, len(cases))


def test_one_token_many_times():
    index = d.build([(i, "same " * 60) for i in range(20)])
    began = time.monotonic()
    assert [x[:3] for x in d.leaks("same " * 5_000, index)] == [(i, 60, 60) for i in range(20)]
    assert len(d.leaks("same " * 5_000 + "more " * 9, d.build([(i, "same " * (60 + i)) for i in range(20)]))) == 20
    assert d.leaks("same " * 12 + "other", index) == []
    assert time.monotonic() - began < 20


def test_tiny_items_repeated_rows_and_null_ids(spark):
    items = [(1, "ab"), (2, "AB, cd"), (3, "ab cd ef"), (4, "ab cd ef gh"), (None, "zz"), (5, ""), (6, None), (6, "zz"), (6, "zz")]
    docs = [(1, "x ab cd ef gh"), (2, "xab"), (2, "cd ef gh"), (3, "ab"), (3, "ab"), (None, "zz"), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (3, 1), (None, None), (None, 6)], key=str)
    assert sorted(r.doc_id for r in d.without_leaks(df, bench).collect()) == [2, 2, 4, 5]
