"""Null and repeated ids, and rows that repeat as a whole."""

import duckdb

from brindle.llm import mixing as M


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_three_thousand_null_ids(spark, tmp_path):
    rows = [(None, " ".join(f"w{i}" for i in range(3 + k % 40)) + f" n{k}", "a") for k in range(3000)]
    rows += [(k, "one two three four five six", "b") for k in range(2000)] + [(7, f"x y z{k}", None) for k in range(500)]
    path = table(spark, tmp_path, rows)
    got = sorted(map(tuple, M.op7_mix_to_weights(spark, path).select("size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT size, source_size, target, taken FROM ({M.SQL})").fetchall())
    narrow = M.cut(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", M.word_count(M.F.col("text")).alias("size"), M.seeded(M.F.col("doc_id"), M.F.col("text"), "s").alias("digest")))
    assert narrow.where("doc_id IS NULL").select("digest").distinct().count() == 3000
    few, many = ({tuple(r) for r in M.plans(narrow, M.Mix(broadcast_sources=n)).collect()} for n in (0, 100))
    assert few == many and len(few) == 3


def test_rows_that_repeat_as_a_whole(spark, tmp_path):
    rows = [(None, "a b c d", "s")] * 900 + [(1, "e f g h", "s")] * 900 + [(k, "i j", "t") for k in range(10, 100)]
    out = M.op7_mix_to_weights(spark, table(spark, tmp_path, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    for size in {r.source_size for r in out}:
        own = [r for r in out if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 900
