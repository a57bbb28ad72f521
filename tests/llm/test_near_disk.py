import random

import numpy as np

from brindle.llm import simhash as S
from brindle.llm.near import Near, bins, most_common
from tests.llm.test_near import brute, edited


def shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def half_alike():
    """Groups of texts that share half of their words, and a near copy of each fifth."""
    rnd, texts = random.Random(8), []
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    for _ in range(10):
        base = own(300)
        for i in range(10):
            words = base + own(300)
            texts += [" ".join(words)] + [" ".join(edited(rnd, words, 4))] * (i % 5 == 0)
    return texts


def test_unlike_texts_are_not_shuffled_for_verification(spark):
    texts = half_alike()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).checkpoint()
    before = shuffled(spark)
    kept = sorted(r.doc_id for r in S.keep_one(docs).collect())
    took = shuffled(spark) - before
    assert kept == brute(texts)
    assert took < 3 * sum(map(len, texts))


def test_nothing_broadcast_gives_the_same(spark):
    texts = half_alike()[:44]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.keep_one(docs, Near(broadcast_rows=0)).collect()) == brute(texts)


def test_bins_bound_what_sets_share():
    rnd = np.random.default_rng(4)
    draw = lambda n, most: rnd.integers(0, most, n, dtype=np.uint64)
    for n, m, shared, most in [(1, 1, 1, 1 << 63), (3, 900, 2, 1 << 63), (700, 40, 30, 1 << 63), (500, 560, 480, 1 << 63), (900, 700, 600, 1 << 20)]:
        both = draw(shared, most)
        a, b = (np.unique(np.concatenate([both, draw(x - shared, most)])) for x in (n, m))  # the last: all in one bin
        assert most_common(bins(a), bins(b)) >= len(np.intersect1d(a, b))
    a, b = draw(600, 1 << 63) * np.uint64(2), draw(600, 1 << 63) * np.uint64(2)
    assert most_common(bins(a), bins(b)) < 480
    assert most_common(bins(a[:0]), bins(b)) == 0
