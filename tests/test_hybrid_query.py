import math
import re
from collections import Counter

from brindle.operators.retrieval import STOP_WORDS
from brindle.plans import QUERIES

DOCS = [(i, f"title{i} page\n" + " ".join(f"w{(i * k) % 23}" for k in range(1, 12 + i % 5)), "en", f"s{i % 3}") for i in range(1, 30)]
ITEMS = [(1, "what is it that they w1 w2 w4 w6 w9 w17 w22 nowhere"), (2, "none of these words here w5 w7 title8"), (3, "w3 w8 w3 w10 w11 w12 w13 w14 w15 s2")]


def brute(text):
    """Documents in order of BM25 with all of the question's terms."""
    fields = lambda d: ((10.0, d[1].split("\n")[0]), (5.0, d[3]), (1.0, d[1]))
    words = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    tf, dl = {}, {}
    for d in DOCS:
        tf[d[0]], dl[d[0]] = Counter(), sum(len(words(t)) for _, t in fields(d))
        for w, t in fields(d):
            for x in words(t):
                tf[d[0]][x] += w
    n, avg, score = len(DOCS), sum(dl.values()) / len(DOCS), Counter()
    for term in {t for t in text.lower().split() if len(t) >= 2 and t not in STOP_WORDS}:
        df = sum(term in c for c in tf.values())
        for d, c in tf.items():
            if term in c:
                score[d] += max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * dl[d] / avg))
    return sorted(score, key=lambda d: (-round(score[d], 9), str(d)))[:10]


def test_hybrid_search_asks_whole_items(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["hybrid_search"](spark, str(tmp_path)).collect()
    for i, text in ITEMS:
        assert [int(r.doc_id) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == i] == brute(text)


def test_terms_joined_by_shuffle_score_alike(spark):
    from pyspark.sql import functions as F

    from brindle.operators import retrieval as R

    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    asked = spark.createDataFrame(ITEMS, "query_id long, text string").select("query_id", R.query_terms(F.col("text")).alias("terms"))
    for conjunctive in (True, False, None):
        a, b = (sorted(map(tuple, R.bm25(asked, R.postings(docs, {"text": 1.0}), R.lengths(docs, ["text"]), 10, conjunctive, broadcast_terms=n).collect())) for n in (0, 1000))
        assert a == b and (a or conjunctive)
