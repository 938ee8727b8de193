import random
import re

from tabloom.llm import licenses as lic

TEXTS = dict((label, text) for label, text in lic.TEMPLATES)


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _brute(text, templates, threshold):
    """Places of the phrases, and (label, start, end, overlap, words) of every block and template compared."""
    words = _words(text)
    places = []
    for phrase, label in lic.PHRASES:
        want = phrase.split(" ")
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    found = set()
    for label, t in templates:
        want = _words(t)
        if not want:
            continue
        step = 16
        while step < len(want):
            step *= 2
        for start in range(0, len(words), step):
            if start and start + step >= len(words):  # the block before reaches the end
                continue
            held = set(words[start : start + 2 * step])
            overlap = len(held & set(want))
            if overlap * 100 >= threshold * len(set(want)):
                found.add((label, start, start + 2 * step, overlap, len(set(want))))
    return words, sorted(places), found


def _case():
    rnd = random.Random(3)
    common = sorted({w for _, t in lic.TEMPLATES for w in _words(t)})
    docs = [(None, None), (1, None), (1, "\x00"), (2, ""), (3, " .,;\n"), (4, "cc by cc by"), (4, "cc by cc by"), (4, "CC-BY 4.0"),
            (5, "MIT\nLicense, the Apache   license and the mit License"), (None, "GNU General Public License"),
            (6, "cc bye"), (7, "occ by"), (8, "straße cc by ñandú"), (9, "ＣＣ by cc by"), (10, "K" * 3 + " cc\x0bby")]
    for i in range(60):
        words = [rnd.choice(common + ["ein", "zwei", "drei"] * 20) for _ in range(rnd.randint(0, 300))]
        if i % 3:
            part = _words(rnd.choice(lic.TEMPLATES)[1])
            for _ in range(rnd.randint(0, 1 + len(part) // 9)):
                part[rnd.randrange(len(part))] = "anders"
            at = rnd.randint(0, len(words))
            words[at:at] = part
        docs.append((100 + i, rnd.choice([" ", "\n * ", ", "]).join(words)))
    docs.append((999, "wort " * 60_000 + TEXTS["bsd"] + " wort" * 1_000 + " Released under the MIT License."))
    return docs


def test_against_brute_force(spark):
    docs = _case()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(map(repr, [
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in lic.scan(df).collect()
    ]))
    want = []
    for i, text in docs:
        words, places, found = _brute(text, lic.TEMPLATES, lic.THRESHOLD)
        base = sorted({label for _, label in places})
        want.append((
            i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, base,
            sorted({*base, *(f[0] for f in found)}), round(max((f[3] / f[4] for f in found), default=0.0), 9),
        ))
    assert got == sorted(map(repr, want))
    blocks = sorted((r.doc_id or 0, r.label, r.start, r.end, r.overlap, r.words) for r in lic.matching_blocks(df).collect())
    assert blocks == sorted({(i or 0, *f) for i, t in docs for f in _brute(t, lic.TEMPLATES, lic.THRESHOLD)[2]})
    assert len(blocks) > 40


def test_lower_thresholds_parts_and_no_templates(spark, monkeypatch):
    docs = _case()[:-1]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(lic, "BLOCK_BYTES", 300)  # several parts
    for threshold in (50, 100):
        got = {(r.doc_id or 0, r.label, r.start, r.end, r.overlap, r.words) for r in lic.matching_blocks(df, threshold=threshold).collect()}
        assert got == {(i or 0, *f) for i, t in docs for f in _brute(t, lic.TEMPLATES, threshold)[2]}
    assert lic.matching_blocks(df, templates=[("none", " "), ("never", "wörter die nirgends stehen")]).count() == 0


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lic.scan(empty).count() == 0
    clash = spark.createDataFrame([(1, "cc by", 7, "x", 3)], "doc_id bigint, text string, n_words int, labels string, __k1 int")
    rows = lic.scan(clash).collect()
    assert [(r.doc_id, r.n_words, r.labels) for r in rows] == [(1, 2, ["cc-by"])]
