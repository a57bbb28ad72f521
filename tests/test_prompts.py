from pyspark.sql import functions as F

from brindle.functions import prompts as P
from brindle.operators import curate as Q
from brindle.operators import retrieval as R


def test_prompts(spark):
    row = spark.createDataFrame([("q?", "a", None, [("d1", "t", "x" * 400), ("d2", "u", "y")], "/k/api/if.json", "<b>" + "z" * 50)], "q string, a string, r string, docs array<struct<doc_id:string,title:string,content:string>>, file string, raw string")
    got = row.select(
        P.answer_key(F.col("docs"), 1).alias("key"), P.grounded_prompt("Be exact.", F.col("q"), F.col("r")).alias("p"), P.judge_prompt(F.col("q"), F.col("a"), F.col("r"), ("factual", "overall")).alias("j"), P.limited(F.col("raw"), 10).alias("cut"),
        P.one_of(F.col("a"), ["b"], "b").alias("one"), P.specification_record(F.col("file"), F.lit("T"), "ctx", "cat").alias("rec"), Q.context_blocks(F.col("docs"), 2, 5).alias("ctx"),
    ).first()
    assert len(got.key) == 350 + 6 and got.p == "Be exact.\n\nQuestion: q?" and '"overall": 0..1' in got.j and "(none)" in got.j
    assert got.cut == "b" + "z" * 9 and got.one == "b" and got.rec.doc_id == "ctx:if" and got.ctx == "[t]\nxxxxx\n\n---\n\n[u]\ny"


def test_prefix_search_and_vectors(spark):
    docs = spark.createDataFrame([("a", "virtual servers", "the pool"), ("b", "pools", "pool pool"), ("c", "other", "nothing")], "doc_id string, heading string, text string")
    q = spark.createDataFrame([(1, ["poo", "virt"]), (2, ["poo", "zzz"])], "query_id int, terms array<string>")
    rows = R.prefix_search(q, docs, {"heading": 2.0, "text": 1.0}).collect()
    assert [r.doc_id for r in rows if r.query_id == 1] == ["a"] and {r.doc_id for r in rows if r.query_id == 2} == {"a", "b"}
    assert R.contains_filter(docs.withColumn("kind", F.lit("k")), "POOL", ["heading", "text"], "k").count() == 2
    v = docs.select(R.hashed_vector(F.col("text")).alias("v")).first().v
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6
    assert docs.select(R.embedding_input(F.col("heading"), F.col("text"), 3).alias("e")).first().e == "search_document: virtual servers\nthe"
