import re
from collections import Counter

from pyspark.sql import functions as F

from brindle.llm import quality_rules as Q
from tests.llm.conftest import corpus


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_and_base(spark, folder):
    got = sorted((str(r.doc_id), *r[1:]) for r in Q.op2_host_quality_rules(spark, folder).collect())
    want = []
    for i, text, *_ in corpus():
        c = brute(text)
        want.append((str(i), *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert [g[:7] for g in got] == sorted(want)
    assert not any(g[6] and g[7] for g in got)
    kept = {g[0]: g[7] for g in got}
    assert kept["1"] and kept["203"] and not kept["206"] and not kept["200"]


def test_query_against_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    names = ["doc_id", *Q.COUNTS, "base_failed", "kept"]
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({Q.SQL})").fetchall())
    assert Counter(map(tuple, Q.op2_host_quality_rules(spark, folder).select(names).collect())) == want


def test_colliding_hashes_are_counted_again(monkeypatch):
    import numpy as np

    from brindle.llm import kernel

    monkeypatch.setattr(kernel, "mixed", lambda x: (x % 2).astype(np.uint64))
    rnd = np.random.default_rng(0)
    ids = np.concatenate([rnd.integers(0, 50, 60), np.arange(10), np.arange(10)])
    assert kernel.repeated_words(ids, np.array([0, 60, 80])).tolist() == [0, 20]


def test_bad_host_is_rejected_and_small_host_is_not(spark):
    good = "these are twenty one plain words that no rule can hold against the text in which they all stand here now ok"
    rows = [(i, "bad", "bad") for i in range(60)] + [(100, good, "bad")] + [(200 + i, good, f"h{i % 5}") for i in range(100)] + [(400, "bad", "tiny"), (401, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert 100 not in kept and 401 in kept and len(kept) == 101


def test_stage_keeps_columns(docs, empty):
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    assert out.where(F.col("doc_id") == 1).count() == 1 and out.where("doc_id = 206 or doc_id = 201").count() == 0
    assert Q.keep_good(empty).count() == 0


def test_shuffled_verdicts_agree(docs):
    few = Q.HostRules(watch=0.01, reject=0.02)
    none = Q.HostRules(watch=0.01, reject=0.02, broadcast_hosts=0)
    assert sorted(map(str, Q.keep_good(docs, few).collect())) == sorted(map(str, Q.keep_good(docs, none).collect()))
