import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from brindle.llm import sharding as S
from tests.llm.conftest import corpus


def check(rows, shards=8):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def test_query(spark, folder):
    rows = S.op10_histogram_shards(spark, folder).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check(rows)


def test_even_bytes_and_whole_groups(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("a"), F.floor(F.col("id") / 2).cast("string").alias("b")).select("doc_id", F.concat("b", "a").alias("text"))
    rows = S.sharded(df).collect()
    check(rows)
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 8
    assert max(abs(n - mean) for n in size.values()) < 0.01 * mean
    own = defaultdict(set)
    for r in rows:
        own[r.text].add(r.shard)
    assert all(len(s) == 1 for s in own.values())


def test_a_hot_group_is_split_and_others_are_not(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = S.sharded(df).collect()
    check(rows)
    size, own = Counter(), defaultdict(set)
    for r in rows:
        size[r.shard] += r["size"]
        own[r.text].add(r.shard)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(n - mean) for n in size.values()) < 0.01 * mean
    assert [t for t, s in own.items() if len(s) > 1] == ["the same text"]


def test_rows_that_repeat_stay_together(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (3, None), (None, None)], "doc_id long, text string")
    rows = S.sharded(df).collect()
    check(rows)
    assert len(rows) == 53 and len({r.shard for r in rows if r.text == "a"}) == 1


def test_columns_and_empty(docs, empty):
    out = S.sharded(docs)
    assert set(docs.columns) | {"size", "text_crc32", "law", "shard", "slot", "grown_shard"} == set(out.columns)
    check(out.collect())
    assert S.sharded(empty).count() == 0
