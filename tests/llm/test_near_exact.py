import random

from brindle.llm.near import Near, near_links, sketched
from brindle.llm.common import components, cut
from pyspark.sql import functions as F
from tests.llm.test_near import brute


def test_no_link_of_a_crowd_is_lost(spark):
    """Texts that share four fifths of their shingles, so that sketches crowd: copies are found whatever hashes choose."""
    rnd = random.Random(2)
    base, texts = [f"b{i}" for i in range(110)], []
    for i in range(50):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(26)]
        texts.append(" ".join(base + own))
        for _ in range(1 + (i % 4 == 0)):
            texts.append(" ".join(base[: 108 - i % 3] + own))  # words lost at the seam
        tail = own[:-15] + [f"x{rnd.randrange(10**6)}" for _ in range(15)]
        texts.append(" ".join(base + tail))  # close to the limit
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    row = F.xxhash64("doc_id", "text")
    for plan in (Near(), Near(order_share=1), Near(order_share=10**9)):  # the order of shingles doesn't change the result
        marked = cut(sketched(docs.select("doc_id", "text", row.alias("__row")), plan, ["doc_id", "__row"]))
        root = components(near_links(docs, marked, row, plan))
        found = marked.join(root, marked["fp"] == root["node"], "left").select("doc_id", F.coalesce("root", "fp").alias("root"))
        assert sorted(r.d for r in found.groupBy("root").agg(F.min("doc_id").alias("d")).collect()) == brute(texts)
