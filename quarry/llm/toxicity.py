"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is trained from confirmed toxic texts and unlabelled texts. With the
class prior p, sigmoid loss l and mean losses over positives (P) and unlabelled (U), the risk is
p*P[l(+)] + max(0, U[l(-)] - p*P[l(-)]); where the second part is below zero, the step goes
the other way along it (the non-negative correction). The prior is the share of toxic labels among the rows
that may be learned from. Features of a text are its distinct words with their first 4 to 6
letters, hashed; buckets that confirmed texts hold no more often than unlabelled ones are left out; a
text's score is a logistic function of the sum of its words' weights.

Only labels of rows with crc32(doc_id as text) mod 5 other than 0 are used, and no column but the
text enters a score. The training sample is bounded by the documented ``Sample`` parameters and
chosen by a hash of doc_id, so reruns agree: the ids of the least hashes, one text for each, the
least of its texts where an id is repeated. The driver takes no more than that many texts, of each the chosen buckets only.

Defined cases: a null text counts as empty and gets the score of a text without words; rows
without labels or with null labels are only unlabelled text; a null doc_id is never held out and never in the sample;
repeated rows score alike; without any toxic label to learn from every score is 0; other columns
are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, small_batches, text_of, written

WORDS = re.compile(r"\w+")
FOLDS = 5


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample in texts, of the model in buckets, and of the buckets that it chooses."""

    positives: int = 3000
    unlabelled: int = 6000
    buckets: int = 1 << 18
    chosen: int = 1 << 14
    min_z: float = 6.0
    epochs: int = 200
    rate: float = 0.03


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(word: str, buckets: int) -> list[int]:
    """Buckets of a word and of its beginnings."""
    keys = [word] + [f"{word[:n]}\x00" for n in (4, 5, 6) if len(word) > n]
    return [crc32(k.encode("utf-8", "replace")) % buckets for k in keys]


def text_words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def fit(texts: list[np.ndarray], positive: np.ndarray, prior: float, s: Sample, counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias from each text's chosen buckets, which may be repeated or have counts."""
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    index = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    times = np.concatenate([*(counts or map(np.ones_like, texts)), np.zeros(0)]).astype(float)
    used, index = np.unique(index, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, s.epochs + 1):
        z = np.bincount(row, w[index] * times, len(texts)) + b
        sig = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = sig * (1 - sig)
        as_positive = np.where(positive, -prior * slope / n_p, 0)
        as_negative = np.where(positive, -prior * slope / n_p, slope / n_u)
        negative_risk = sig[~positive].sum() / n_u - prior * sig[positive].sum() / n_p
        g = as_positive + as_negative if negative_risk >= 0 else -as_negative
        gw, gb = np.bincount(index, g[row] * times, len(used)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= s.rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= s.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    weights = np.zeros(s.buckets)
    weights[used] = w
    return weights, float(b)


def least_ids(rows: DataFrame, n: int) -> DataFrame:
    """The n ids of the least hashes. All but about 2 * n are passed over where they are read, so few are shuffled."""
    key = F.xxhash64("doc_id")
    several = rows.agg(F.approx_count_distinct("doc_id", 0.05)).first()[0]
    share = min(1.0, (2 * n + 100) / max(1, several * 0.8))
    near = rows.select("doc_id").filter(key <= int(-(2**63) + share * (2**64 - 2**12))) if share < 1 else rows.select("doc_id")
    return near.distinct().orderBy(key, "doc_id").limit(n)


def training_sample(docs: DataFrame, labels: DataFrame, s: Sample) -> tuple[pd.DataFrame, float]:
    """On the driver: (chosen buckets, their counts, positive) of at most positives + unlabelled texts, and the prior."""
    small_batches(docs.sparkSession)
    key = F.xxhash64("doc_id")
    learn = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    n, toxic = learn.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not toxic:
        return pd.DataFrame({"buckets": [], "counts": [], "positive": []}), 0.0
    confirmed = least_ids(learn.filter("toxic = 1"), s.positives)
    others = least_ids(docs.filter(~held_out() & F.col("doc_id").isNotNull()), s.unlabelled)
    # at most positives + unlabelled ids: a bounded broadcast, and a bounded table
    marks = written(confirmed.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False))), "marks")
    buckets = s.buckets

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(np.array([f for w in text_words(t) for f in features(w, buckets)], np.int32)) for t in texts], dtype=object)

    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marks), "doc_id")
    rows = rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    rows = written(rows.select("doc_id", "positive", hashed("text").alias("buckets")), "sample")
    chosen = chosen_buckets(rows, s)

    @F.pandas_udf("struct<buckets:array<int>,counts:array<int>>")
    def chosen_only(buckets: pd.Series) -> pd.DataFrame:
        found = [np.unique(b[np.isin(b, chosen)], return_counts=True) for b in buckets]
        return pd.DataFrame({"buckets": pd.Series([b for b, _ in found], dtype=object), "counts": pd.Series([n.astype(np.int32) for _, n in found], dtype=object)})

    rows = rows.select(chosen_only("buckets").alias("x"), "positive", key.alias("k"), "doc_id").orderBy("positive", "k", "doc_id")
    return rows.select("x.buckets", "x.counts", "positive").toPandas(), toxic / n


def chosen_buckets(rows: DataFrame, s: Sample) -> list[int]:
    """Buckets in which confirmed texts lie ``min_z`` standard deviations more often than unlabelled
    texts lead to expect, the s.chosen strongest. Counted on the executors."""
    n_p, n_u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    once = rows.select("positive", F.explode(F.array_distinct("buckets")).alias("bucket"))
    counts = once.groupBy("bucket").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    expected = n_p * F.greatest(F.col("u"), F.lit(1)) / max(1, n_u)
    strong = counts.withColumn("z", (F.col("p") - expected) / F.sqrt(expected)).filter((F.col("p") >= 3) & (F.col("z") > s.min_z))
    return sorted(r["bucket"] for r in strong.orderBy(F.desc("z"), "bucket").limit(s.chosen).select("bucket").collect())


class Scorer:
    """Scores texts in one Python worker; remembers the sums of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            got = float(self.weights[features(w, len(self.weights))].sum())
            if len(self.known) < 100_000 and len(w) <= 64:
                self.known[w] = got
        return got

    def score(self, text: str) -> float:
        z = self.bias + sum(sorted(x for x in map(self.word, text_words(text)) if x))  # in one order: reruns agree
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Column:
    """A score column for rows with a column ``text``, after training on docs and labels."""
    rows, prior = training_sample(docs, labels, sample)
    if not prior:
        return F.lit(0.0)
    texts, counts = ([np.asarray(x, np.int64) for x in c] for c in (rows.buckets, rows.counts))
    weights, bias = fit(texts, rows.positive.to_numpy(bool), prior, sample, counts)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    name = f"toxicity {uuid.uuid4()}"

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        scorer = kept(name, lambda: Scorer(*shared.value))
        return batch.map(scorer.score).astype("float64")

    return scored(text_of())


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    score = toxicity(docs, labels, sample)
    return docs.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


ship(__name__)
