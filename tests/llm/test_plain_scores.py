"""Scores of the classifiers worked out again word by word from their parameters, and odd ratings."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import features, ordinal, toxicity
from brindle.llm.common import fold_of
from tests.llm.conftest import corpus

TRIM, SYMBOLS = ".,;:!?\"'()[]{}<>|#*$%&", "#*$%&|<>~^=+_@\\"


def buckets(text):
    out = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        out.add(zlib.crc32(w.lower().strip(TRIM).encode()) % features.SIZE)
        if w[-1] in SYMBOLS:
            out.add(zlib.crc32(("\0" + w[-1]).encode()) % features.SIZE)
    return out


def logistic(x):
    return 1 / (1 + math.exp(-min(max(x, -40), 40)))


def test_toxicity_scores(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.fitted(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold_of(F.col("doc_id"), 5) == 0, toxicity.NonNegativePU())
    weights = weights.astype(np.float32)
    want = sorted((str(i), round(logistic(bias + sum(float(weights[b]) for b in buckets(t))), 5)) for i, t, *_ in corpus())
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in toxicity.op6_positive_unlabelled_toxicity(spark, folder).collect()) == want


def test_grades(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    weights, dense, cuts = ordinal.fitted(docs, ratings, ordinal.CumulativeLink())
    weights, want = weights.astype(np.float32), []
    for i, t, *_ in corpus():
        score = sum(float(weights[b]) for b in buckets(t)) + float(features.dense(pa.array([t or ""], pa.large_string()))[0] @ dense)
        tail = [logistic(score - c) for c in cuts]
        want.append((str(i), round(sum(tail), 4), round(tail[0], 4)))
    assert len(cuts) == 2
    assert sorted((str(r.doc_id), round(r.expected_grade, 4), round(r.tail_probability, 4)) for r in ordinal.op4_ordinal_quality(spark, folder).collect()) == sorted(want)


def test_ratings_of_one_grade(spark, docs):
    for grade, kept in ((0, False), (1, True), (2, True)):
        ratings = spark.createDataFrame([(i, grade) for i in range(10)], "doc_id long, grade int")
        got = {(r.expected_grade, r.kept) for r in ordinal.graded(docs.select("doc_id", "text"), ratings).collect()}
        assert got == {(float(grade), kept)}


def test_null_quality_has_no_grade(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (0, 1), (1, 1), (1, None), (1, 0)], "quality int, toxic int")
    assert [r[0] for r in df.select(ordinal.grade_of(F.col("quality"), F.col("toxic"))).collect()] == [None, None, 0, 1, 2, 2]
