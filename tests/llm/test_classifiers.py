import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import features, ordinal, toxicity
from tests.llm.conftest import corpus


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Texts of grade 0 (symbols), 1 (with a bad word) and 2, most of them labelled."""
    rnd, path = random.Random(2), str(tmp_path_factory.mktemp("labelled"))
    word = lambda: rnd.choice("able bake cold door even fine good hand idea jump kind love make note open past".split()) + rnd.choice(["", "s", "ing"])
    docs, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(rnd.randint(30, 120))]
        kind = i % 5
        if kind == 0:
            w = [x + "###" if rnd.random() < 0.8 else x for x in w]
        if kind == 1:
            for bad in rnd.sample(["vile", "scoundrel", "Rotter,", "cad"], 2):
                w.insert(rnd.randrange(len(w)), bad)
        docs.append((i, " ".join(w), "en", "s"))
        if i % 3:
            labels.append((i, int(kind > 0), int(kind == 1)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_texts(spark, labelled):
    rows = toxicity.op6_positive_unlabelled_toxicity(spark, labelled).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1500 and all(r.held_out == fold(r.doc_id) for r in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 5 == 1) for r in held]) > 0.95


def test_labels_of_the_held_out_fold_are_not_used(spark, labelled):
    docs, labels = (spark.read.parquet(f"{labelled}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs.select("doc_id", "text"), x, held).collect()} for x in (labels, turned))
    assert a == b


def test_risk_does_not_go_below_zero():
    """With the prior set too high the plain estimator would call everything toxic."""
    n = 400
    text = np.repeat(np.arange(n), 2)
    positive = (n, text, np.tile([1, 2], n))
    unlabelled = (n, text, np.stack([np.full(n, 1), np.where(np.arange(n) < 40, 2, 3)], 1).ravel())
    w, b = toxicity.fit(positive, unlabelled, 0.1, toxicity.NonNegativePU())
    assert w[1] + w[2] + b > 0 > w[1] + w[3] + b


def test_ordinal_on_held_out_texts(spark, labelled):
    rows = [r for r in ordinal.op4_ordinal_quality(spark, labelled).collect() if fold(r.doc_id)]
    assert np.mean([r.kept == (r.doc_id % 5 > 0) for r in rows]) > 0.97
    mean = [np.mean([r.expected_grade for r in rows if r.doc_id % 5 in k]) for k in ((0,), (1,), (2, 3, 4))]
    assert mean[0] < 0.5 < mean[1] < 1.6 < mean[2]


def test_ordinal_thresholds_are_in_order_and_gradient_is_right():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.integers(0, 30, (n, 4))
    z = (x < 10).sum(1) + rng.normal(0, 0.3, n)
    grade = np.digitize(z, [0.8, 1.6, 2.6])
    more = np.zeros((n, features.DENSE))
    w, _, cuts = ordinal.fit(grade, np.repeat(np.arange(n), 4), x.ravel(), more, ordinal.CumulativeLink(steps=400))
    assert len(cuts) == 3 and (np.diff(cuts) > 0).all() and w[:10].min() > w[10:30].max()
    expected = ordinal.tails(w[x].sum(1), cuts).sum(1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85


def test_odd_rows(spark, folder):
    for query in (toxicity.op6_positive_unlabelled_toxicity, ordinal.op4_ordinal_quality):
        rows = query(spark, folder).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(c[0]) for c in corpus())
    assert {r.predicted for r in rows if hasattr(r, "predicted")} <= {0, 1}


def test_no_labels_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int, grade int")
    own = docs.select("doc_id", "text")
    assert {r.predicted for r in toxicity.toxicity(own, none, F.lit(False)).collect()} == {0}
    assert {r.kept for r in ordinal.graded(own, none).collect()} == {True}
    assert toxicity.toxicity(empty.select("doc_id", "text"), none, F.lit(False)).count() == 0 and ordinal.graded(empty.select("doc_id", "text"), none).count() == 0


def test_the_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    ids = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    a, b = ({r.doc_id for r in features.sample(x, 50).collect()} for x in (ids, ids.repartition(7)))
    assert a == b and len(a) == 50
