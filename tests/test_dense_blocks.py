import math
import random

from brindle.operators import retrieval as R


def test_all_queries_are_searched(spark):
    rnd = random.Random(2)
    vector = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    queries, vectors = [(i, vector()) for i in range(25)], [(i % 12, vector()) for i in range(20)]
    asked = spark.createDataFrame(queries, "query_id long, q array<double>")
    got = R.dense(asked, spark.createDataFrame(vectors, "doc_id long, v array<double>"), 3, most_queries=4).collect()
    want = set()
    for i, q in queries:
        best = {}
        for d, v in vectors:
            s = round(sum(a * b for a, b in zip(q, v, strict=True)) / math.hypot(*q) / math.hypot(*v), 6)
            best[d] = max(best.get(d, -2), s)
        want |= {(i, d, k) for k, d in enumerate(sorted(best, key=lambda d: (-best[d], d))[:3], 1)}
    assert len(got) == 75 and {(r.query_id, r.doc_id, r.rank) for r in got} == want
