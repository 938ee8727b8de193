import random
import re

from pyspark.sql import functions as F

from tabloom.llm import quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if SPACE.sub("", x):
            dup += x in seen
            seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def _texts():
    rnd = random.Random(12)
    words = ["a", "b", "é", "𝒳#", "|", "c\x0bd", "x\xa0y", "\x1c"]
    texts = [rnd.choice([" ", "\n", "\t ", " \n"]).join(rnd.choices(words[: rnd.randint(1, 8)], k=rnd.randint(0, 60))) for _ in range(150)]
    part = " ".join(f"p{i}" for i in range(30))
    texts += ["", None, "\n\n \n", part, part + " " + part, f"{part} q {part} r", "w " * 5000, " ".join(f"u{i}" for i in range(30_000)) + " " + part + " z " + part]
    return texts + ["one\r\none\r\ntwo", "l\nl\nl\n\n\n"]


def test_base_against_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    got = quality.base_counts(df).withColumn("f", failed).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.f) == _brute(texts[r.doc_id]), r.doc_id


def _corpus(spark):
    rnd = random.Random(3)
    good = [f"{a}{b}" for a in "bdfglm" for b in ("ar", "en", "ist", "ol", "u")]
    doc = lambda i: " ".join(rnd.choice(good) + (rnd.choice(["%%%", "###"]) if i % 6 == 0 else "") for _ in range(rnd.randint(25, 120)))
    docs = [(i, doc(i)) for i in range(400)] + [(None, None), (401, ""), (5, doc(5)), (5, doc(5))]
    labels = [(i, int(i % 6 != 0)) for i in range(0, 400, 2)] + [(None, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_verdicts_and_determinism(spark):
    docs, labels = _corpus(spark)
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == 404
    clean = [r.kept for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 6]
    junk = [r.kept for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 6 == 0]
    assert all(clean) and not any(junk)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (None, 401))
    again = quality.judged(docs.repartition(5), labels.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_score_against_brute_force(spark):
    docs, labels = _corpus(spark)
    raw = {}
    hashed = docs.select("doc_id", "text", quality.grams(F.transform(F.split("text", " "), lambda w: F.xxhash64(w))).alias("g")).filter("doc_id < 400")
    for r in hashed.collect():
        for b in r.g:
            raw[b] = raw.get(b, 0) + 1
    counted = {r["bucket"]: r["n"] for r in quality.bucket_counts(docs.filter("doc_id < 400")).collect()}
    assert counted == raw
    half = quality.bucket_counts(docs.filter("doc_id < 400 and doc_id % 6 <> 0"))
    weights = quality.log_ratios(half, quality.bucket_counts(docs.filter("doc_id < 400")))
    assert len(weights) == quality.BUCKETS and min(weights) < 0 < max(weights)
    got = hashed.limit(20).withColumn("s", quality.ratio_score(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)), weights))
    for r in got.collect():
        assert abs(r.s - sum(weights[b] for b in r.g) / (quality.UNIT * (len(r.g) + quality.PRIOR_GRAMS))) < 1e-9


def test_empty_tables(spark):
    docs, labels = _corpus(spark)
    assert quality.judged(docs.limit(0), labels).count() == 0
    rows = quality.judged(docs, labels.limit(0)).collect()  # no trusted documents: base rules only
    assert all(r.kept != r.base_failed for r in rows)


def test_every_trusted_document_counts(spark):
    n = 21_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id % 3, ' '), 20)").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.trusted_ids(labels.union(labels)).count() == n
    grams = quality.trusted_grams(docs, labels.union(labels.filter("doc_id < 9")))
    assert grams.count() == n and {r["n"] for r in quality._counts(grams, F.col("grams")).collect()} == {20 * n // 3, 19 * n // 3}


def test_floor_against_exact_percentiles(spark):
    rnd = random.Random(5)
    frame = spark.createDataFrame([(rnd.gauss(0.4, 0.2),) for _ in range(3_000)], "s double")
    middle, low = frame.agg(F.percentile("s", 0.5), F.percentile("s", 0.01)).first()
    assert abs(quality.score_floor(frame) - (middle - quality.SPREADS * (middle - low) / 2.33)) < 1e-3
    assert quality.score_floor(frame.limit(0)) is None
