"""Retrieval and its evaluation: documents are searched with the benchmark items' words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import evaluate as E
from brindle.operators import retrieval as R
from brindle.plans.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
_TERMS = f"list_filter(regexp_split_to_array(lower(substr(trim(regexp_replace(regexp_replace(%s, '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s{{2,}}', ' ', 'g')), 1, 512)), '\\s+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"
_POSTS = """p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM p GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
_SCORED = """, s AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS met, any_value(n_terms) AS n_terms
 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2) """


def _asked(spark, sf_dir):
    """All terms of the items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(R.query_terms(F.col("text"))).alias("terms"))


def _lexical(spark, sf_dir, limit, conjunctive):
    docs = table(spark, sf_dir, "documents")
    return R.bm25(_asked(spark, sf_dir), R.postings(docs, {"text": 1.0}), R.lengths(docs, ["text"]), limit, conjunctive)


def _q():
    return f"WITH {_POSTS}, a AS (SELECT item_id AS query_id, list_distinct_ordered AS terms FROM (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT item_id, {_TERMS % 'text'} AS t FROM benchmark))), q AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM a)" + _SCORED


@query(_q() + "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, 10, False)


@query(_q() + ", f AS (SELECT *, max(met = n_terms) OVER (PARTITION BY query_id) AS any_full FROM s) SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f WHERE met = n_terms OR NOT any_full) WHERE rank <= 10")
def bm25_or_fallback(spark, sf_dir):
    return _lexical(spark, sf_dir, 10, None)


_N = "n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-9)) AS v FROM embeddings)"
_KNN = f"WITH {_N}, s AS (SELECT a.vec_id AS query_id, %s AS doc_id, round(%s, 9) AS score FROM n a JOIN n b ON a.vec_id %% 50 = 0 %s) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 10"


def _vectors(spark, sf_dir, doc):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense(asked, e.select(F.col(doc).alias("doc_id"), F.col("embedding").alias("v")), 10, most_queries=asked.count())


@query(_KNN % ("b.vec_id", "list_dot_product(a.v, b.v)", ""))
def knn_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, "vec_id")


@query(_KNN % ("b.label", "max(list_dot_product(a.v, b.v))", "GROUP BY 1, 2"))
def knn_maxpool(spark, sf_dir):
    return _vectors(spark, sf_dir, "label")


@query(f"WITH {_N} SELECT vec_id, round(list_sum(v), 6) AS s FROM n")
def l2_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(R.normalized(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


def _lists(spark, sf_dir):
    """Two ranked lists: documents dealt to all items by their ids, by length and by another order."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = items.agg(F.max("item_id") + 1).first()[0]
    own = docs.select("doc_id", "n_chars", F.substring_index("text", "\n", 1).alias("title"), (F.col("doc_id") % n).alias("query_id")).join(items.select(F.col("item_id").alias("query_id")), "query_id")
    rank = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o, "doc_id"))
    a = own.withColumn("rank", rank(F.desc("n_chars"))).where("rank <= 30")
    b = own.withColumn("rank", rank(F.col("doc_id") * 7919 % 101)).where("rank <= 20")
    return a, b


_LISTS = """WITH o AS (SELECT doc_id, n_chars, string_split(text, chr(10))[1] AS title, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS query_id FROM documents WHERE doc_id % (SELECT max(item_id) + 1 FROM benchmark) IN (SELECT item_id FROM benchmark)),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM o) WHERE rank <= 30), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id * 7919 % 101, doc_id) AS rank FROM o) WHERE rank <= 20)"""


def _fused(lists):
    return f"{_LISTS}, l AS ({lists}), f AS (SELECT query_id, doc_id, round(sum(part), 12) AS score, min({{'l': src, 'r': rank}}) AS place FROM l GROUP BY 1, 2) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place.l, place.r, doc_id) AS rank FROM f"


@query(_fused("SELECT query_id, doc_id, 0 AS src, rank, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT query_id, doc_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY rank), 0.5::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY rank)) FROM b WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM a)"))
def rrf_disjoint(spark, sf_dir):
    return R.fuse(*_lists(spark, sf_dir))


@query(_fused("SELECT query_id, doc_id, 0 AS src, rank, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT query_id, doc_id, 1, rank, 1.0::DOUBLE / (60 + rank) FROM b"))
def rrf_overlap(spark, sf_dir):
    return R.fuse(*_lists(spark, sf_dir), mode="overlap")


@query(_LISTS + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(lower(title)) ORDER BY rank) AS k FROM a) WHERE k = 1")
def title_dedupe(spark, sf_dir):
    return R.first_titles(_lists(spark, sf_dir)[0]).select("query_id", "doc_id", "rank")


_M = _LISTS + ", g AS (SELECT query_id, doc_id FROM o JOIN labels USING (doc_id)), m AS (SELECT query_id, min(rank) AS first_rank FROM g LEFT JOIN a USING (query_id, doc_id) GROUP BY 1), r AS (SELECT query_id, first_rank, CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit5, CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit10, coalesce(1.0::DOUBLE / first_rank, 0.0) AS rr FROM m)"


def _metrics(spark, sf_dir):
    a, _ = _lists(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    n = items.agg(F.max("query_id") + 1).first()[0]
    rated = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select((F.col("doc_id") % n).alias("query_id"), "doc_id")
    gold = rated.join(items, "query_id", "left_semi")
    return E.retrieval_metrics(a.select("query_id", "doc_id", "rank"), gold)


@query(_M + " SELECT * FROM r")
def retrieval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(_M + ", k AS (SELECT *, CASE query_id % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'id' WHEN 2 THEN 'code' ELSE 'unknown' END AS kind FROM r) SELECT coalesce(kind, 'ALL') AS kind, count(*) AS n, round(avg(hit5), 4) AS hit5, round(avg(hit10), 4) AS hit10, round(avg(rr), 4) AS rr FROM k GROUP BY ROLLUP (kind)")
def metrics_rollup(spark, sf_dir):
    kind = F.expr("CASE query_id % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'id' WHEN 2 THEN 'code' END")
    return E.rollup(_metrics(spark, sf_dir).withColumn("kind", kind), "kind")


VENDOR, STANDARD = ["pool ", "virtual server", "monitor ", "the "], ["status code", "handshake", "packet ", "and ", "the "]


@query("SELECT conv_id, turn, CASE WHEN a > b THEN 'vendor' WHEN b > a THEN 'standard' ELSE 'general' END AS mode FROM (SELECT conv_id, turn, " + " + ".join(f"contains(lower(text), '{t}')::INT" for t in VENDOR) + " + CASE WHEN regexp_matches(lower(text), '\\bk\\d{4,}\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\\bcve-\\d{4}-\\d+\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\\b\\w+::\\w+') THEN 3 ELSE 0 END AS a, " + " + ".join(f"contains(lower(text), '{t}')::INT" for t in STANDARD) + " AS b FROM conversations)")
def classify_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.classify(F.col("text"), VENDOR, STANDARD).alias("mode"))


@query("SELECT conv_id, turn, regexp_matches(text, '\\bID\\s?\\d{4,}\\b', 'i') OR regexp_matches(text, '\\b(bugs?|defects?)\\b', 'i') AS bug FROM conversations")
def bug_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.bug_intent(F.col("text")).alias("bug"))


@query("SELECT conv_id, turn, " + _TERMS % "text" + " AS terms FROM conversations")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.query_terms(F.col("text")).alias("terms"))


@query("""SELECT l.quality AS model, count(*) AS n, round(avg(l.toxic), 2) AS a, round(avg(d.n_chars % 7), 2) AS b, round(avg(l.toxic + d.n_chars % 7), 2) AS total, sum((d.doc_id % 3 = 0)::INT)::BIGINT AS wins FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def leaderboard_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return E.leaderboard(rows.select(F.col("quality").alias("model"), F.col("toxic").alias("a"), (F.col("n_chars") % 7).alias("b"), (F.col("doc_id") % 3 == 0).alias("best")), ["a", "b"])


@query("SELECT min(n_chars) AS least, list_sort(list(n_chars))[count(*) // 2 + 1] AS median, max(n_chars) AS most FROM documents")
def length_stats(spark, sf_dir):
    return E.upper_median(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(count_if(s >= 0.7) / count(s), 4) AS pass_70, round(count_if(s >= 0.85) / count(s), 4) AS pass_85, count_if(s IS NULL) AS unparsed FROM (SELECT CASE WHEN doc_id % 10 > 0 THEN n_chars % 100 / 100.0::DOUBLE END AS s FROM documents)")
def score_stats(spark, sf_dir):
    return E.pass_stats(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 > 0, F.col("n_chars") % 100 / 100.0).alias("s")), "s")


@query()
def hybrid_vector_search(spark, sf_dir):
    """As hybrid_search, with vectors: bags of hashed words stand in for an embedding."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("keywords"), F.col("text").alias("content"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", R.hashed_vector(F.col("text")).alias("q"))
    return R.hybrid(asked, docs, docs.select("doc_id", R.hashed_vector(F.col("content")).alias("v")), 10)


@query()
def hybrid_search(spark, sf_dir):
    """The benchmark's items as questions over all documents, titles being first lines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("keywords"), F.col("text").alias("content"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.hybrid(asked, docs, None, 10)
