"""Ties at the vocabulary's edge, long words, and means in levels."""

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import lm_score as L


def test_tied_words_fill_the_vocabulary(spark):
    counts = spark.createDataFrame([(f"w{i:03d}", 5) for i in range(300)] + [("top", 9)], "word string, c long")
    for known, want in ((200, ["top"] + [f"w{i:03d}" for i in range(199)]), (1, ["top"]), (1000, ["top"] + [f"w{i:03d}" for i in range(300)])):
        assert L.frequent(counts, L.LogBilinear(known=known))["word"].tolist() == want


def test_a_long_word_counts_as_one_word_and_can_be_a_class(spark):
    line = "-" * 500
    docs = spark.createDataFrame([(i, f"some words {line} é{line} x{i}") for i in range(40)], "doc_id long, text string")
    counts = {r.word: r.c for r in L.word_counts(docs).collect()}
    assert sorted(counts.values(), reverse=True)[:4] == [40] * 4 and sum(counts.values()) == 200 and max(map(len, counts)) <= L.LONG_WORD
    rows = L.scored(docs, F.col("doc_id") % 5 == 1).collect()
    assert {(r.n_tokens, r.n_known) for r in rows if r.held_out} == {(6, 5)} and {(r.n_tokens, r.n_known) for r in rows if not r.held_out} == {(6, 6)}


def test_means_in_levels(spark):
    rng = np.random.default_rng(1)
    rows = [(int(p), float(rng.integers(1, 9)), rng.normal(size=5).astype(np.float32)) for p in rng.permutation(3000)[:1500]]
    frame = spark.createDataFrame([(p, w, bytearray(x.tobytes())) for p, w, x in rows], "part long, weight double, params binary")
    got = L.averaged(frame).collect()
    assert len(got) <= L.FAN_IN and max(r.part for r in got) < L.FAN_IN
    total = sum(r.weight for r in got)
    mean = sum(r.weight / total * np.frombuffer(r.params, np.float32) for r in got)
    assert total == sum(w for _, w, _ in rows) and np.allclose(mean, sum(w * x for _, w, x in rows) / total, atol=1e-5)
