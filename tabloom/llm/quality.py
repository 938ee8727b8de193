"""Quality rules: base counts of a text and a hashed n-gram likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import WORD, durable

#: Hash buckets of the two multinomials.
BUCKETS = 32_768
#: Words in a window of the repetition count.
WINDOW = 8
#: N-grams of a neutral text that every score is diluted with, so that short texts are judged mildly.
PRIOR_GRAMS = 40
#: Pseudo-counts spread like the raw corpus over the target's buckets.
SMOOTHING = 50_000.0
#: Log ratios are kept as whole numbers of this fraction, so sums do not depend on their order.
UNIT = 1_000
#: Trusted scores are counted in steps of this fraction.
SCORE_UNIT = 10_000
#: A document is kept down to so many spreads below the trusted median.
SPREADS = 6.0
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__h`` (hash of each word) and the base counts; a missing text has no words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = docs.withColumn("__h", F.transform(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    return hashed.withColumns(
        {
            "n_words": F.size("__h").cast("bigint"),
            "word_chars": F.length(F.translate(whole, _SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": _repeat_words(F.col("__h")).cast("bigint"),
        }
    )


def _repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words lying in a window of words that occurs twice or more."""
    n = F.size(hashes) - (window - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    count = _let(
        windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_covered(x, window))
    )
    return F.when(n < 2, F.lit(0)).otherwise(count)


def _covered(windows: Column, window: int) -> Column:
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        again = lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["at"]))

    def length(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _let(placed, lambda s: _let(repeated(s), length))


def grams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    ones = F.transform(hashes, bucket)
    pairs = F.transform(hashes, lambda h, i: bucket(F.xxhash64(h, F.get(hashes, i + 1))))
    return F.concat(ones, F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) over all n-grams of (text); buckets bound the result, counts are summed before the shuffle."""
    return _counts(_hashed(docs), grams(F.col("__h")))


def _hashed(docs: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return docs.select(F.transform(words, lambda w: F.xxhash64(w)).alias("__h"))


def _counts(frame: DataFrame, found: Column) -> DataFrame:
    return frame.select(F.explode(found).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents (quality 1)."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def trusted_grams(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(grams) of every trusted document.

    The ids grow with the corpus, so rows meet by shuffle at every size; the ids are the hashed side.
    """
    ids = trusted_ids(labels).hint("shuffle_hash")
    return _hashed(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")).select(grams(F.col("__h")).alias("grams"))


def score_floor(scores: DataFrame) -> float | None:
    """A number of spreads below the median of the scores in ``s``, or None without scores.

    Scores are counted in small steps, so what one task sees is bounded by their range.
    """
    steps = scores.groupBy(F.round(F.col("s") * SCORE_UNIT).cast("bigint").alias("step")).agg(F.count("*").alias("n"))
    middle, low = steps.agg(F.percentile("step", 0.5, F.col("n")), F.percentile("step", 0.01, F.col("n"))).first()
    return None if middle is None else (middle - SPREADS * (middle - low) / 2.33) / SCORE_UNIT


def log_ratios(target: DataFrame, raw: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket the log of target over raw probability, smoothed by the raw one; ``buckets`` numbers."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "r"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left"
    )
    rows = both.select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    r, t = sum(x["r"] for x in rows), sum(x["t"] for x in rows)
    out = [0] * buckets
    for x in rows:
        share = (x["r"] + 0.5) / (r + 0.5 * buckets)
        out[x["bucket"]] = round(UNIT * math.log((x["t"] + SMOOTHING * share) / (t + SMOOTHING) / share))
    return out


def ratio_score(hashes: Column, weights: list[int]) -> Column:
    """Mean log ratio of a text's n-grams, together with the neutral prior ones."""
    known = _known(weights)
    return _let(grams(hashes), lambda g: _mean(g, known))


def _known(weights: list[int]) -> Column:
    # one string, folded to an array when the query is planned
    return F.split(F.lit(" ".join(map(str, weights))), " ").cast("array<int>")


def _mean(g: Column, known: Column) -> Column:
    total = F.aggregate(g, F.lit(0).cast("bigint"), lambda a, b: a + F.get(known, b))
    return total / (UNIT * (F.size(g) + PRIOR_GRAMS))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of docs with base counts, ``base_failed``, ``score`` and ``kept``.

    A missing or empty text has no words and fails the base rules; rows that
    repeat are judged alike and counted each; a score equal to the threshold is
    kept. Columns of docs named like those added, or ``__h``, are replaced.
    The raw multinomial counts every n-gram of the corpus; the target one those
    of every trusted document. The threshold is the median of all trusted scores
    less a number of spreads (median to first percentile over 2.33), so it is
    the same for every run and every document; for it, scores are rounded. Without trusted documents only the base rules decide.
    """
    trusted = durable(trusted_grams(docs, labels))
    weights = log_ratios(_counts(trusted, F.col("grams")), bucket_counts(docs.select("text")))
    # texts of 20 words and more; words and pairs together are twice the words less one
    known = _known(weights)
    scores = trusted.filter(F.size("grams") >= 39).select(_mean(F.col("grams"), known).alias("s"))
    floor = score_floor(scores)
    counted = base_counts(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True) if floor is None else F.col("score") >= F.lit(floor)
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("score", ratio_score(F.col("__h"), weights))
        .withColumn("kept", ~F.col("base_failed") & verdict)
        .drop("__h")
    )
