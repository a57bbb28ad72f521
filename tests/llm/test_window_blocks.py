"""The block join makes the candidates: it gives every pair within the radius, and few others reach verification."""

import random

from pyspark.sql import functions as F

from brindle.llm import decontam as D


def test_fingerprints_by_lanes_and_one_by_one(spark):
    rnd = random.Random(3)
    rows = [(n, [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(n)]) for n in (1, 2, 31, 127, 128, 300)]
    for r in spark.createDataFrame(rows, "n int, h array<long>").select("n", "h", D._print(F.col("h")).alias("p")).collect():
        assert r.p & ((1 << 64) - 1) == sum(1 << b for b in range(64) if sum(v >> b & 1 for v in r.h) * 2 > r.n)


def test_blocks_give_all_pairs_within_the_radius(spark):
    rnd, plan = random.Random(4), D.Windows()
    items = [rnd.getrandbits(64) - (1 << 63) for _ in range(30)]
    windows = []
    for i, mark in enumerate(items):
        for k in range(0, 26, 3):
            windows.append((i * 100 + k, i, 7, k, mark ^ sum(1 << b for b in rnd.sample(range(63), k))))
    w = spark.createDataFrame(windows, "doc_id long, text_hash long, n int, at int, print long")
    full = spark.createDataFrame([(i, mark, n) for i, mark in enumerate(items) for n in (7, 8)], "item long, item_print long, item_n int")
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(d, i) for d, _, _, _, m in windows for i, x in enumerate(items) if bits(m, x) <= plan.radius}
    for p in (plan, D.Windows(broadcast_rows=0)):
        assert {(r.doc_id, r.item) for r in D.candidates(w, full, p).collect()} == want


def test_fingerprints_remove_windows(spark):
    """Of windows that begin at some shingle of an item, those far from it are no candidates."""
    rnd, plan = random.Random(6), D.Windows()
    item = [f"v{rnd.randrange(500)}" for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join([f"u{rnd.randrange(500)}" for _ in range(60)] + item + [f"t{rnd.randrange(500)}" for _ in range(60)])) for i in range(20)], "doc_id long, text string")
    full = D.item_prints(D.prepared(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), plan), 5)
    anchors = full.select(F.col("item_n").alias("n"), F.explode("item_hashes").alias("hash"))
    windows = D.fingerprinted(docs, D.cut(D.starts(docs, anchors, 5)), 5, plan)
    assert windows.count() == 20 * 36
    kept = D.candidates(windows, full, plan).count()
    assert 20 <= kept < 20 * 18
