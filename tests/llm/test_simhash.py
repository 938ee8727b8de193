import random

import xxhash

from tabloom.llm import simhash


def _brute_print(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lowered + " ":
        if c in " \t\n\r\x0b\x0c":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _brute_components(rows, radius=4):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def _texts():
    rnd = random.Random(5)
    words = ["Ab", "cD", "éÉ", "x", "YY", "zed", "ſ", "K"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 90))) for _ in range(60)]
    near = []
    for t in base[:20]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "new"
        near.append(" \t".join(w))
    return base + base[:10] + near + ["", None, " \n\t ", "one", "ONE two\x0bthree", "a b c d e f"]


def test_fingerprint_against_brute_force():
    for t in _texts():
        assert simhash.fingerprint_of(t) & (2**64 - 1) == _brute_print(t)
    long = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint_of(long) & (2**64 - 1) == _brute_print(long)


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    prints = [rnd.getrandbits(64) for _ in range(40)]
    for p in prints[:15]:  # chains of near prints
        for _ in range(6):
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                p ^= 1 << b
            prints.append(p)
    prints += [0, 0, 1, 2**64 - 1]
    rows = [(i if i % 9 else None, p) for i, p in enumerate(prints)] + [(4, prints[4])]
    signed = [(d, p - 2**64 if p >= 2**63 else p) for d, p in rows]
    df = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = _brute_components(rows)
    assert got == {(d, s, c) for (d, s), c in zip(signed, want)}


def test_small_tiles_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "_BAND_ROWS", 3)
    monkeypatch.setattr(simhash, "_BLOCK", 2)
    test_components_against_brute_force(spark)


def test_dense_group_gives_a_forest():
    group = [1 << i | 1 << j for i in range(20) for j in range(i)]
    links = simhash.links_between(group, group, True, 4)
    assert len(links) == len(group) - 1


def test_keep_one_over_odd_rows(spark):
    rows = [
        (3, "a b c d e", "x", 1), (1, "a b c d e", "y", 2), (1, "a b c d e", "y", 2), (None, "a b c d e", None, 3),
        (None, "q r", "z", 4), (None, "q r", "z", 4), (7, None, None, None), (8, "", "s", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, `component id.x` int")
    got = sorted(simhash.keep_one(df).collect(), key=str)
    assert got == sorted([rows[1], rows[4], rows[6]], key=str)
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_tells_a_missing_text_from_a_nul(spark):
    df = spark.createDataFrame([(1, None), (1, "\x00"), (None, "\x00")], "doc_id bigint, text string")
    assert sorted(simhash.keep_one(df).collect(), key=str) == sorted([(1, None), (1, "\x00")], key=str)
