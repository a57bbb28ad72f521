"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text of the training fold is unlabelled, whatever its labels
say, as most toxic text has no label. With the class prior p, the risk of calling unlabelled text clean also counts
the positives among it; the estimator takes these off and doesn't let the rest fall below zero: while it would, the
step goes the other way, which keeps the classifier from fitting the sample (Kiryo and others, 2017).

The classifier is linear in hashed words, each counted once a text. Only buckets whose share of documents differs
between the samples by several standard errors get a weight; the others would only learn single texts by heart. Both
samples are bounded by parameters; every text is scored, whole.

Defined results: null and empty texts get the score of the bias alone; labels that are null or without a document are
left out, repeated labels count once; without positives or text all scores are the prior; repeated documents get a row
each, and count in training as often as they come; very long texts are read whole; empty tables give empty ones; further
columns don't disturb.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import cut, fold_of, table
from brindle.llm.features import SIZE, Adam, linear_scores, sample, telling, training_rows


@dataclass(frozen=True)
class NonNegativePU:
    #: At most so many positives and unlabelled documents are trained on, by hash of doc_id.
    positives: int = 3000
    unlabelled: int = 9000
    #: A bucket needs so many documents, and a difference of so many standard errors.
    least_documents: int = 8
    errors: float = 4.0
    steps: int = 600
    rate: float = 0.05
    decay: float = 2e-5
    beta: float = 0.0
    gamma: float = 1.0
    #: The class prior; if None, the share of toxic labels in the training fold (with one more label that is 5% toxic).
    prior: float | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: tuple, unlabelled: tuple, prior: float, plan: NonNegativePU) -> tuple[np.ndarray, float]:
    """Weights of buckets and a bias, from (n, text, bucket) of both samples."""
    in_p, in_u = np.bincount(positive[2], minlength=SIZE), np.bincount(unlabelled[2], minlength=SIZE)
    seen = (in_p + in_u >= plan.least_documents) & telling(in_p, in_u, positive[0], unlabelled[0], plan.errors)
    place, size = np.cumsum(seen) - 1, int(seen.sum())

    def own(n, text, bucket):
        use = seen[bucket]
        return n, text[use], place[bucket[use]]

    pos, unl = own(*positive), own(*unlabelled)
    theta, adam = np.zeros(size + 1), Adam(size + 1, plan.rate)
    theta[-1] = np.log(prior / (1 - prior))

    def back(of, grad):
        return np.append(np.bincount(of[2], grad[of[1]], size), grad.sum())

    for _ in range(plan.steps):
        fp, fu = (theta[-1] + np.bincount(x[1], theta[x[2]], x[0]) for x in (pos, unl))
        # logistic losses of calling a text toxic, l(f), and clean, l(-f)
        clean_p, clean_u = np.logaddexp(0, fp).mean(), np.logaddexp(0, fu).mean()
        rest = clean_u - prior * clean_p
        g_rest = back(unl, _sigmoid(fu) / unl[0]) - prior * back(pos, _sigmoid(fp) / pos[0])
        if rest >= -plan.beta:
            grad = prior * back(pos, -_sigmoid(-fp) / pos[0]) + g_rest
        else:
            grad = -plan.gamma * g_rest
        decay = plan.decay * theta
        decay[-1] = 0
        theta += adam.step(grad + decay)
    weights = np.zeros(SIZE)
    weights[seen] = theta[:-1]
    return weights, float(theta[-1])


def fitted(docs: DataFrame, labels: DataFrame, held_out: Column, plan: NonNegativePU) -> tuple[np.ndarray, float]:
    """Weights of buckets and a bias, from the labels and texts that aren't held out."""
    marks = labels.where(~held_out & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, k = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0))).first()
    prior = min(max(plan.prior if plan.prior is not None else (k + 0.05) / (n + 1), 1e-4), 0.9)
    positive = sample(marks.where("toxic > 0").select("doc_id", F.lit(1).alias("y")), plan.positives)
    unlabelled = sample(docs.where(~held_out & F.col("doc_id").isNotNull()).select("doc_id", F.lit(0).alias("y")), plan.unlabelled)
    y, text, bucket, _ = training_rows(docs, cut(positive.union(unlabelled)), with_dense=False)
    weights, bias = np.zeros(SIZE), float(np.log(prior / (1 - prior)))
    if y.any() and not y.all():
        number = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0)) - 1
        part = lambda own: (int(own.sum()), number[text[own[text]]], bucket[own[text]])
        weights, bias = fit(part(y > 0), part(y == 0), prior, plan)
    return weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, plan: NonNegativePU | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of docs (doc_id, text). labels: doc_id, toxic; held_out: a condition on
    doc_id under which no label is used."""
    weights, bias = fitted(docs, labels, held_out, plan or NonNegativePU())

    def finish(sums):
        score = _sigmoid(sums + bias)
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    found = linear_scores(docs.select("doc_id", "text", held_out.alias("held_out")), weights, None, finish, more, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_positive_unlabelled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold_of(F.col("doc_id"), 5) == 0)
