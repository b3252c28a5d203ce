"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled texts train a sparse linear classifier in numpy. With the class prior pi, the risk
of the negative class is that of the unlabelled texts less pi times that of the positives taken as negative, and is kept
from falling below zero: where a step would push it there, its gradient is turned round.

Features are words and their leading letters (3 to 8), present or absent in a text. Only those found in at least
MIN_POSITIVE, and MIN_SHARE, of the sampled positives, and more often than in the unlabelled, are features; a model has MAX_FEATURES of
them at most, and so is bounded, however large the corpus is.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the classifier is fitted on, at most: labelled toxic rows, and rows taken as unlabelled text.
MAX_POSITIVE, MAX_UNLABELLED = 1_500, 4_500
#: Distinct words of such a row, at most: those with the least checksum.
MAX_WORDS = 20_000
MIN_POSITIVE, MIN_SHARE, MAX_FEATURES = 4, 0.005, 2_048
#: Share of the documents whose labels are held out: crc32(doc_id) mod 4 = 2.
HELD_OUT = "pmod(crc32(encode(cast(%s as string), 'UTF-8')), 4) = 2"
THRESHOLD = 0.3
WORD_CACHE = 60_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


#: A word's features: itself, and its first 3 to 8 letters; None if it has fewer.
KINDS = [lambda w: w, *[lambda w, k=k: f"{w[:k]}*" if len(w) >= k else None for k in range(3, 9)]]


def features_of(word: str) -> list[str]:
    return [f for kind in KINDS if (f := kind(word))]


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def hits(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            got = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return got

    def score(self, text: str | None) -> float:
        found = set().union(*map(self.hits, tokens(text)))
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __getstate__(self):
        return (self.weights, self.bias)

    def __setstate__(self, state):
        self.__init__(*state)


def train(positive: list[list[str]], unlabelled: list[list[str]], prior: float, steps: int = 600, rate: float = 0.05, penalty: float = 2e-4) -> Model:
    """Fit by full-batch Adam on the non-negative risk with the logistic loss, with soft thresholding; weights are 0 or more.

    Each text is its distinct words. Without positives or a prior, the model has no features and scores everything alike,
    near the prior.
    """
    prior = min(max(prior, 1e-3), 0.5)
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, base)
    least = max(min(MIN_POSITIVE, len(positive)), MIN_SHARE * len(positive))
    p_rate, lift = {}, {}
    for kind in range(len(KINDS)):  # one kind of feature at a time, which bounds the counters
        of = lambda words, kind=kind: {f for w in words if (f := KINDS[kind](w))}
        in_p = {f: c for f, c in Counter(f for t in positive for f in of(t)).items() if c >= least}
        in_u = Counter(f for t in unlabelled for f in of(t) if f in in_p)
        p_rate |= {f: (c + 0.1) / len(positive) for f, c in in_p.items()}
        lift |= {f: p_rate[f] / ((in_u[f] + 0.5) / len(unlabelled)) for f in in_p}
    # a feature of toxic texts alone is 1 / prior times as frequent in them as in unlabelled ones; the rest are too common elsewhere
    names = sorted((f for f in lift if lift[f] > 0.6 / prior), key=lambda f: (-lift[f] * np.sqrt(p_rate[f]), f))[:MAX_FEATURES]
    at = {f: k for k, f in enumerate(names)}

    def matrix(rows):
        x = np.zeros((len(rows), len(names)), dtype=np.float32)
        for i, t in enumerate(rows):
            x[i, [at[f] for w in t for f in features_of(w) if f in at]] = 1
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(names), dtype=np.float32), base
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        # loss(z) = log(1 + exp(-z)) for a positive and log(1 + exp(z)) for a negative
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_pos = -prior * sig(-zp) / len(zp)
        gp_neg, gu = -prior * sig(zp) / len(zp), sig(zu) / len(zu)
        if negative >= 0:
            gp, gu = gp_pos + gp_neg, gu
        else:
            gp, gu = -gp_neg, -gu
        g, gb = xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32), float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(v / c2) + 1e-6)
        w = w - scale * (m / c1)
        w = np.maximum(w - np.minimum(scale * penalty, rate), 0)  # what these features say is toxicity, or nothing
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-3}, float(b))


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [" ".join(sorted(heapq.nsmallest(MAX_WORDS, tokens(t), key=lambda w: zlib.crc32(w.encode())))) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"], "positive": pdf["positive"], "words": words})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on rows that aren't held out: at most MAX_POSITIVE labelled toxic ones, and MAX_UNLABELLED of any kind.

    Both are those with the least hash of the id; an id counts once, with one of its texts. The prior is the toxic share
    of all labels that aren't held out. What goes to the driver are MAX_WORDS distinct words of each at most.
    """
    mine = f"{id_col} is not null and not {HELD_OUT % id_col}"
    by_hash = [F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.col(id_col)]
    own = labels.where(mine).select(id_col, "toxic").where("toxic is not null").distinct()
    prior = own.agg(F.avg("toxic")).first()[0] or 0.0
    pos = own.where("toxic = 1").select(id_col).distinct().orderBy(*by_hash).limit(MAX_POSITIVE)
    some = docs.where(mine).select(id_col).distinct().orderBy(*by_hash).limit(MAX_UNLABELLED)
    pick = pos.select(id_col, F.lit(True).alias("positive")).union(some.select(id_col, F.lit(False).alias("positive")))
    # MAX_POSITIVE + MAX_UNLABELLED ids at most
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(pick), id_col).select(F.col(id_col).alias("id"), "positive", "text")
    rows = rows.mapInPandas(_sampled, f"id {dict(rows.dtypes)['id']}, positive boolean, words string").groupBy("id", "positive").agg(F.min("words").alias("words"))
    sets: dict[bool, list[list[str]]] = {True: [], False: []}
    for r in rows.toLocalIterator():
        sets[r.positive].append([sys.intern(w) for w in r.words.split()])
    return train(sorted(sets[True]), sorted(sets[False]), float(prior))


def _scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= THRESHOLD) of each whole text.

    Null, empty and wordless texts have the score of a text without features. Repeated rows are scored each. Columns of
    these two names are replaced. Empty tables give no rows, and empty labels one score for all. A row's own label, lang,
    source and id are no inputs.
    """
    score = _scorer(docs.sparkSession, fit(docs, labels, id_col, text_col))
    return docs.drop("score", "predicted").withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", F.expr(HELD_OUT % "doc_id").alias("held_out"), "score", "predicted")
