"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_text
from tabloom.llm.common import durable

#: Labelled documents used for fitting, at most so many clean and toxic ones.
SAMPLE = (6_000, 3_000)
#: Features kept: those that lean most towards toxic, so many per toxic document within these bounds.
FEATURES = (256, 4_096)
FEATURES_PER_TOXIC = 6
#: A feature must occur in so many sampled documents.
LEAST_DOCUMENTS = 3
#: Shortest and longest prefixes of a word that are features beside the word itself.
PREFIXES = (3, 7)
#: Share of the toxic documents in the weight of all sampled ones.
TOXIC_WEIGHT = 0.2
#: Expected severity from which a document counts as toxic.
TOXIC_FROM = 0.5
#: Words whose features a task remembers.
WORDS_HELD = 500_000
#: Thresholds of a model without features, which calls nothing toxic.
NEVER = (30.0,)
_EDGES = re.compile(r"^\W+|\W+$")
_ROUNDS, _STEP, _MOMENTUM, _SHRINK = 600, 2.0, 0.9, 1e-3


@dataclass(frozen=True)
class Model:
    """Weights shared by all thresholds: P(grade > k) = sigmoid(weight . x - threshold[k])."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]


def features_of(text: str | None) -> dict[str, int]:
    """How often each word, and each prefix of a word, occurs; prefixes end in an asterisk."""
    out: dict[str, int] = {}
    for word, n in Counter((text or "").lower().split()).items():
        for name in _names(word):
            out[name] = out.get(name, 0) + n
    return out


def _names(word: str) -> list[str]:
    word = _EDGES.sub("", word)
    if not word:
        return []
    return [word, *(word[:k] + "*" for k in range(PREFIXES[0], min(PREFIXES[1], len(word)) + 1))]


def sample_ids(labels: DataFrame, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, toxic): up to so many clean and toxic labelled documents, in hash order."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [hash_text("doc_id", 11), F.col("doc_id")]
    picks = [known.filter(F.col("toxic") == t).orderBy(*order).limit(most[t]) for t in (0, 1)]
    return picks[0].union(picks[1])


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled documents.

    The labels say toxic or not; severity grades are made from them: 0 for a
    clean document, 1 to 3 for a toxic one by thirds of its share of telling
    words. Features are screened by Spark over the sample; the driver sees only
    the sampled documents' counts of the features that were kept. So a grade is
    made from the features themselves: it orders documents by how much of their
    text tells, and is no second opinion on the labels. Rows of docs that share a
    sampled id count as one document, whose features add up.
    """
    picked = docs.select("doc_id", "text").join(F.broadcast(durable(sample_ids(labels, most))), "doc_id")
    counts = durable(picked.select("doc_id", "toxic", F.udf(lambda t: features_of(t), "map<string,int>")("text").alias("f")))
    size = {r["toxic"]: r["count"] for r in counts.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model({}, NEVER)
    held = counts.select("doc_id", "toxic", F.explode("f").alias("feature", "n"))
    by_label = held.groupBy("feature").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    )
    bad, good = (F.col("bad") + 0.5) / (size[1] + 1.0), (F.col("good") + 0.5) / (size[0] + 1.0)
    telling = F.log(bad / good) * (bad - good)
    kept = min(max(FEATURES_PER_TOXIC * size[1], FEATURES[0]), FEATURES[1])
    best = by_label.filter((F.col("bad") + F.col("good") >= LEAST_DOCUMENTS) & (bad > good)).orderBy(telling.desc(), "feature").limit(kept)
    # numbers stand for the features: at most FEATURES of them, for each of the sampled documents
    numbered = F.row_number().over(Window.orderBy("feature")) - 1
    best = durable(best.select("feature", F.log(bad / good).alias("lean")).withColumn("i", numbered))
    names = best.orderBy("i").toArrow()
    plain = F.when(~F.endswith("feature", F.lit("*")), F.col("n"))
    words = held.groupBy("doc_id", "toxic").agg(F.coalesce(F.sum(plain), F.lit(1)).alias("words")).orderBy("doc_id").toArrow()
    rows = held.join(F.broadcast(best), "feature").select("doc_id", "i", "n").toArrow()
    if not len(names):
        return Model({}, NEVER)
    return _fit_rows(
        rows["doc_id"].to_numpy(),
        rows["i"].to_numpy(),
        rows["n"].to_numpy(),
        words["doc_id"].to_numpy(),
        words["toxic"].to_numpy(),
        words["words"].to_numpy(),
        names["feature"].to_pylist(),
        names["lean"].to_numpy(),
    )


def _fit_rows(doc_ids, f, n, ids, toxic, length, names: list[str], leans) -> Model:
    """Fit from (document, feature, count) rows and one row per document, ids in order."""
    d = np.searchsorted(ids, doc_ids)
    order = np.lexsort((n, f, d))  # sums do not depend on the order the rows came in
    d, f, n = d[order], f[order], n[order]
    share = np.bincount(d, weights=n * (leans[f] > 3.0), minlength=len(toxic)) / np.maximum(length, 1)
    cuts = np.quantile(share[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (share > cuts[0]) + (share > cuts[1]), 0)
    levels = np.unique(grade)
    grade = np.searchsorted(levels, grade)
    k = len(levels) - 1
    up = (grade[:, None] > np.arange(k)[None, :]).astype(np.float64)
    # whatever the sample's mixture, the labels weigh alike in every fit
    share_of = np.array([1 - TOXIC_WEIGHT, TOXIC_WEIGHT]) / np.bincount(toxic, minlength=2)
    weight = share_of[toxic]
    w, theta = np.zeros(len(leans)), np.linspace(1.0, 2.0, k)
    vw, vt = np.zeros(len(w)), np.zeros(k)
    for _ in range(_ROUNDS):
        near_w, near_t = w + _MOMENTUM * vw, theta + _MOMENTUM * vt
        score = np.bincount(d, weights=near_w[f], minlength=len(toxic))
        p = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - near_t[None, :], -30, 30)))
        miss = (p - up) * weight[:, None]
        gw = np.bincount(f, weights=miss.sum(axis=1)[d], minlength=len(w)) + _SHRINK * near_w
        vw = _MOMENTUM * vw - _STEP * gw
        vt = _MOMENTUM * vt + _STEP * miss.sum(axis=0)
        w, theta = w + vw, np.maximum.accumulate(theta + vt)
    return Model(dict(zip(names, map(float, w))), tuple(map(float, theta)))


class Scorer:
    """Expected grades of texts; remembers which features the words met so far have."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> float:
        """The sum over thresholds of the chance to lie above."""
        weights, known, held = self.model.weights, self.known, set()
        for word in set((text or "").lower().split()):
            names = known.get(word)
            if names is None:
                if len(known) >= WORDS_HELD:
                    known.clear()
                names = known[word] = tuple(f for f in _names(word) if f in weights)
            held.update(names)
        score = math.fsum(weights[f] for f in held)
        return sum(1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, score - t)))) for t in self.model.thresholds)


def _severity(spark: SparkSession, model: Model, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)  # a bounded number of weights

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for some in texts:
            yield pd.Series([scorer(t) for t in some], dtype="float64")

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows of docs with ``severity`` and ``toxic``; columns of these names are replaced.

    A missing or empty text has no features and the severity of one.
    """
    severity = _severity(docs.sparkSession, model, F.col(text))
    return docs.withColumn("severity", severity).withColumn("toxic", F.col("severity") >= TOXIC_FROM)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the fitted model does not reject; all columns as they were.

    The model is fitted on the labelled rows of docs. A missing or empty text has
    no features and stays; repeated rows are judged alike, each of them. Without
    labelled rows of both kinds, or without any rows, nothing is rejected.
    """
    return docs.filter(_severity(docs.sparkSession, fit(docs, labels), F.col("text")) < TOXIC_FROM)
