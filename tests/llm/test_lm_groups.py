"""Outputs in groups: normalised whatever the sizes, and a vocabulary of contexts that grows."""

import numpy as np
import pyarrow as pa

from brindle.llm import lm_score as L


def test_groups_sum_to_one():
    plan, rng = L.LogBilinear(classes=300, contexts=300, group=16), np.random.default_rng(0)
    v = L.Vocabulary([f"w{i}" for i in range(300)], np.arange(300, 0, -1), 10, plan)
    share = rng.random(v.outputs)
    model = L.Model(v, share / share.sum())
    assert model.size == 21 and len(model.G) == -(-v.outputs // 21)
    model.Q, model.G = rng.normal(0, 1, model.Q.shape).astype(np.float32), rng.normal(0, 1, model.G.shape).astype(np.float32)
    for r in rng.normal(0, 1, (5, plan.dims)).astype(np.float32):
        p = model.log_probability(np.repeat(r[None], v.outputs, 0), np.arange(v.outputs))
        assert abs(np.exp(p).sum() - 1) < 1e-4
    assert np.allclose(model.log_probability(np.stack([r, r]), np.array([v.outputs - 1, 3])), p[[v.outputs - 1, 3]], atol=1e-5)
    same = L.Model(v, model.share).set(model.get())
    assert all(np.array_equal(getattr(same, k), getattr(model, k)) for k in L.Model.NAMES)


def test_one_group_is_a_plain_softmax():
    plan = L.LogBilinear(classes=4, contexts=4)
    v = L.Vocabulary(["a", "b", "c", "d"], np.full(4, 9), 3, plan)
    model = L.Model(v, np.full(v.outputs, 1 / v.outputs))
    t, z = model.table()
    y, before, *_ = v.tokens(pa.array(["a b c d x a"], pa.large_string()))
    r = t[0][before[0]] + t[1][before[1]] + t[2][before[2]]
    assert np.allclose(model.log_probability(r, y), np.einsum("ij,ij->i", r, model.Q[y]) + model.b[y] - z[before[0], before[1], before[2]], atol=1e-5)


def test_a_rare_content_word_tells_the_next_one():
    """Words past the fiftieth by count influence the next word's probability, each in its own way."""
    rng, plan = np.random.default_rng(1), L.LogBilinear(batch=512, classes=400, contexts=400, group=32)
    words = [f"w{i}x" for i in range(400)]
    follower = rng.permutation(400)
    text = []
    for i in rng.integers(0, 400, 40_000):
        text += [words[i], words[follower[i]]]
    v = L.Vocabulary(words, np.full(400, 200), 1, plan)
    share = np.full(v.outputs, 1e-5)
    share[:401] = 1
    model = L.Model(v, share / share.sum())
    y, before, *_ = v.tokens(pa.array([" ".join(text)], pa.large_string()))
    step = model.trainer(plan, 1)
    for _ in range(3):
        for at in range(0, len(y), plan.batch):
            step(y[at : at + plan.batch], before[:, at : at + plan.batch])
    t = model.positions()
    p = model.log_probability(t[0][before[0]] + t[1][before[1]] + t[2][before[2]], y)
    assert p[1::2].mean() > -4.5  # the follower; a draw among 400 words is at -5.99


def test_contexts_grow_with_the_corpus(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 900}" for j in range(60))) for i in range(100)], "doc_id long, text string")
    seen, train = [], L.train
    monkeypatch.setattr(L, "train", lambda d, v, s: seen.append((v.own, v.plan.contexts)) or train(d, v, s))
    L.scored(docs, F.col("doc_id") < 0, L.LogBilinear(classes=8, contexts=8, growth=2))
    distinct = len({(i * j) % 900 for i in range(100) for j in range(60)})
    assert seen == [(2 * int(distinct**0.5), 2 * int(distinct**0.5))]
