"""Quality by ordinal cumulative-link regression on graded ratings.

A text has one score: weights of its hashed words (each once a text) and a few dense features. Ordered thresholds cut
the score's line into grades: P(grade > k) is the logistic function of the score less threshold k. All grades share
the weights, and the thresholds stay in order, as each is the one before plus an exponential. The expected grade ranks
texts, and the tail probability of reaching a grade selects them.

Ratings are graded 0, 1, 2, ... from what the labels say: here 0 for quality 0, 1 for quality 1 but toxic, 2 for
quality 1 and not toxic. Documents are kept if they probably reach grade 1.

Defined results: null and empty texts are scored by the dense features; null ratings and those without a document are
left out, of repeated ratings the lowest counts; if all ratings are of one grade every text gets that grade, and is kept
if it reaches the grade asked for; without ratings every text gets that grade and is kept; repeated documents get a row
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
from brindle.llm.features import DENSE, SIZE, Adam, linear_scores, sample, telling, training_rows


@dataclass(frozen=True)
class CumulativeLink:
    #: At most so many rated documents are trained on, by hash of doc_id.
    most: int = 10_000
    #: A bucket gets a weight if it has so many documents and its share of documents differs by so many standard errors
    #: between the texts that reach some grade and the others.
    least_documents: int = 8
    errors: float = 4.0
    steps: int = 400
    rate: float = 0.05
    decay: float = 2e-5
    #: The grade to reach, and the probability from which a document is kept.
    grade: int = 1
    keep: float = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2), ... for each score."""
    far = np.where(np.isposinf(thresholds), 0.0, 1.0)
    return np.where(np.isinf(thresholds), far, _sigmoid(score[:, None] - np.where(np.isinf(thresholds), 0.0, thresholds)))


def fit(grade: np.ndarray, text: np.ndarray, bucket: np.ndarray, more: np.ndarray, plan: CumulativeLink) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of buckets and dense features, and thresholds, by Adam on the mean log-likelihood."""
    levels, n = int(grade.max()), len(grade)
    seen = np.zeros(SIZE, bool)
    total = np.bincount(bucket, minlength=SIZE)
    for k in range(1, levels + 1):
        high = grade >= k
        inside = np.bincount(bucket[high[text]], minlength=SIZE)
        seen |= telling(inside, total - inside, int(high.sum()), int(n - high.sum()), plan.errors)
    seen &= total >= plan.least_documents
    place = np.cumsum(seen) - 1
    use = seen[bucket]
    text, bucket, size = text[use], place[bucket[use]], int(seen.sum())
    reach = np.array([(grade >= k).mean() for k in range(1, levels + 1)]).clip(0.01, 0.99)
    start = -np.log(reach / (1 - reach))
    theta = np.concatenate([np.zeros(size + DENSE), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    adam = Adam(len(theta), plan.rate)
    rows = np.arange(n)
    for _ in range(plan.steps):
        cuts = theta[size + DENSE] + np.concatenate([[0], np.cumsum(np.exp(theta[size + DENSE + 1 :]))])
        score = np.bincount(text, theta[bucket], n) + more @ theta[size : size + DENSE]
        tail = np.concatenate([np.ones((n, 1)), tails(score, cuts), np.zeros((n, 1))], 1)
        p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
        slope = tail * (1 - tail)
        up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p
        g_score = -(up - down) / n
        g_cut = np.zeros(levels)
        for k in range(levels):
            g_cut[k] = (up[grade == k + 1].sum() - down[grade == k].sum()) / n
        grad = np.concatenate([np.bincount(bucket, g_score[text], size), more.T @ g_score, [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(theta[size + DENSE + 1 :])])
        grad[:size] += plan.decay * theta[:size]
        theta += adam.step(grad)
    weights = np.zeros(SIZE)
    weights[seen] = theta[:size]
    cuts = theta[size + DENSE] + np.concatenate([[0], np.cumsum(np.exp(theta[size + DENSE + 1 :]))])
    return weights, theta[size : size + DENSE], cuts


def fitted(docs: DataFrame, ratings: DataFrame, plan: CumulativeLink) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of buckets and of dense features, and thresholds."""
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("y"))
    y, text, bucket, more = training_rows(docs, cut(sample(rated, plan.most)), with_dense=True)
    grade = y.astype(np.int64)
    if len(np.unique(grade)) > 1:
        return fit(grade, text, bucket, more, plan)
    own = int(grade[0]) if len(grade) else plan.grade
    return np.zeros(SIZE), np.zeros(DENSE), np.where(np.arange(1, max(own, plan.grade) + 1) <= own, -np.inf, np.inf)


def graded(docs: DataFrame, ratings: DataFrame, plan: CumulativeLink | None = None) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of docs (doc_id, text). ratings: doc_id, grade (0, 1, 2, ...)."""
    plan = plan or CumulativeLink()
    weights, dense, cuts = fitted(docs, ratings, plan)

    def finish(sums):
        tail = tails(sums, cuts)
        own = tail[:, min(plan.grade, tail.shape[1]) - 1]
        return {"expected_grade": tail.sum(1), "tail_probability": own, "kept": own >= plan.keep}

    kinds = [("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("kept", T.BooleanType())]
    return linear_scores(docs.select("doc_id", "text"), weights, dense, finish, [T.StructField(*k) for k in kinds], ["doc_id"])


def grade_of(quality: Column, toxic: Column) -> Column:
    """Null if the quality is; a null toxic counts as not toxic."""
    return F.when(quality == 0, 0).when(quality.isNotNull() & (toxic > 0), 1).when(quality.isNotNull(), 2)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the ratings outside the fold crc32(doc_id) mod 5 = 0, so that accuracy can be measured there."""
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    ratings = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return graded(table(spark, sf_dir, "documents"), ratings)
