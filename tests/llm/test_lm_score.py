import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from brindle.llm import lm_score as L
from tests.llm.conftest import corpus


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_query_against_brute_force(spark, folder):
    rows, counts, ends = corpus(), Counter(), 0
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for i, text, *_ in rows:
        if not out(i):
            counts.update(tokens(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(i), out(i), len(t := tokens(text)) + 1, sum(w in counts for w in t) + 1, n, round(sum(log(counts[w]) for w in t) + log(ends), 6)) for i, text, *_ in rows)
    got = L.op3_log_bilinear_scores(spark, folder).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_rare_words_are_joined(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 1
    a, b = (sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in L.scored(docs, F.coalesce(held, F.lit(False)), L.LogBilinear(known=k)).collect()) for k in (50, 100_000))
    assert a == b


def test_probabilities_sum_to_one_and_learn():
    rng = np.random.default_rng(0)
    plan = L.LogBilinear(classes=6, contexts=4, batch=256)
    words = [f"w{i}" for i in range(6)]
    v = L.Vocabulary(words, np.full(6, 1000), 100, plan)
    share = np.full(v.outputs, 1e-4)
    share[:7] = 1
    model = L.Model(v, share / share.sum())
    text, now = [], 0
    for _ in range(60_000):  # the next word is mostly the one after
        now = (now + 1) % 6 if rng.random() < 0.9 else int(rng.integers(6))
        text.append(words[now])
    y, before, *_ = v.tokens(pa.array([" ".join(text)], pa.large_string()))
    step = model.trainer(plan, 1)
    for _ in range(4):
        for at in range(0, len(y), plan.batch):
            step(y[at : at + plan.batch], before[:, at : at + plan.batch])
    t, z = model.table()
    s = np.exp((t[0][1] + t[1][0] + t[2][3]) @ model.Q.T + model.b - z[1, 0, 3])
    assert abs(s.sum() - 1) < 1e-4
    p = (np.einsum("ij,ij->i", t[0][before[0]] + t[1][before[1]] + t[2][before[2]], model.Q[y]) + model.b[y] - z[before[0], before[1], before[2]]).mean()
    assert p > -1.2  # unigrams: -log 6 = -1.79


def test_forms_are_in_range():
    f = L.forms(pa.array(["a", "z,", ".", "é", "é.", "7", "#", "été"], pa.large_string()))
    assert f.min() >= 0 and f.max() < L.FORMS and L._small_forms(f).max() < L._SMALL


def test_empty_and_no_training_text(spark, empty, docs):
    from pyspark.sql import functions as F

    assert L.scored(empty.select("doc_id", "text"), F.lit(False)).count() == 0
    rows = L.scored(docs.select("doc_id", "text"), F.lit(True)).collect()
    assert len(rows) == len(corpus()) and {r.train_tokens for r in rows} == {0} and all(math.isfinite(r.score) for r in rows)
