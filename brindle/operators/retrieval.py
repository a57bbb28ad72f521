"""Hybrid retrieval: identifiers, BM25 over postings, dense nearest neighbours, and rank fusion.

Postings are a table, so scores are joins and partial sums: a query's terms are few and go along, and only postings of
these terms are grouped. Ranks are explicit columns and every order ends in the id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about what is sought (fixed values).
STOP_WORDS = [
    "a", "an", "the", "is", "it", "its", "be", "are", "was", "were", "been", "do", "does", "did", "have", "has", "had", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "i", "me", "my", "we", "our", "you", "your", "he", "she", "they", "them", "this", "that",
    "these", "those", "what", "which", "who", "whom", "whose", "and", "but", "or", "nor", "for", "so", "yet", "of", "in", "on", "at", "to", "from",
    "by", "with", "as", "into", "through", "any", "all", "some", "no", "not", "only", "than", "too", "very", "just", "also", "both", "each", "how",
    "when", "where", "why", "tell", "give", "know", "show", "find", "get", "let", "make", "see", "please", "explain", "describe", "about",
    "regarding", "related", "reference", "information", "provide", "detail", "details", "more", "there", "here", "then", "now", "up", "out", "if",
    "use", "used", "using", "uses", "work", "works", "working", "example", "examples", "sample", "syntax", "governs", "govern", "rfc",
]
# Forms of identifiers (fixed values).
ARTICLE = r"(?i)\b(K\d{4,})\b"
STANDARD = r"(?i)\brfc[\s-]?(\d{1,5})\b"
ADVISORY = r"(?i)\b(CVE-\d{4}-\d+)\b"
COMMAND = r"\b([A-Za-z]+::[A-Za-z_]+)\b"
K1, B, FLOOR = 1.2, 0.75, 1e-6


def query_terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Terms of a question in order; letters beyond ASCII part words."""
    clean = F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", " "), r"\s{2,}", " ")), 1, 512)
    return F.filter(F.split(F.lower(clean), r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(*stop))


def classify(text: Column, vendor_terms: list[str], standard_terms: list[str]) -> Column:
    """vendor, standard or general: which kind of terms the question has more of; identifiers count three. Lists may
    repeat a term, which then counts again."""
    q = F.lower(text)
    own = sum((F.when(q.rlike(p), 3).otherwise(0) for p in (r"\bk\d{4,}\b", r"\bcve-\d{4}-\d+\b", r"\b\w+::\w+")), F.lit(0))
    points = lambda terms: sum((F.when(F.contains(q, F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    a, b = own + points(vendor_terms), points(standard_terms)
    return F.when(a > b, "vendor").when(b > a, "standard").otherwise("general")


def bug_intent(text: Column) -> Column:
    return text.rlike(r"(?i)\bID\s?\d{4,}\b") | text.rlike(r"(?i)\b(bugs?|defects?)\b")


def sources_for(text: Column, mode: Column, by_mode: dict[str, list[str] | None], bugs: str) -> Column:
    """The sources that a mode searches, null for all; a question about bugs adds that source to the vendor's."""
    out = F.lit(None).cast("array<string>")
    for m, own in by_mode.items():
        if own is not None:
            base = F.array(*[F.lit(s) for s in own])
            out = F.when(mode == m, F.when(bug_intent(text), F.array_append(base, F.lit(bugs))).otherwise(base) if m == "vendor" else base).otherwise(out)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def postings(docs: DataFrame, weights: dict[str, float], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf): each term's weighted frequency over the fields of weights."""
    weighted = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    parts = [F.transform(words(F.coalesce(F.col(f), F.lit(""))), weighted(w)) for f, w in weights.items()]
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.concat(*parts)).alias("p")).groupBy("doc_id", "p.term").agg(F.sum("p.w").alias("tf"))


def lengths(docs: DataFrame, fields: list[str], doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), reduce(lambda a, b: a + b, [F.size(words(F.coalesce(F.col(f), F.lit("")))) for f in fields]).cast("double").alias("dl"))


def bm25(queries: DataFrame, posts: DataFrame, dl: DataFrame, limit: int, conjunctive: bool | None = None, k1: float = K1, b: float = B, broadcast_terms: int = 200_000) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, terms), the best limit of each.

    conjunctive: True for documents that have all terms, False for any, None for all, or any where none has all.
    Document frequencies are counted for the queries' terms only. Up to so many terms of all queries are broadcast, and
    a document's postings are then in one place, where its scores for all queries are summed; more are joined by shuffle.
    """
    asked = queries.select("query_id", F.size(F.array_distinct("terms")).alias("n_terms"), F.explode(F.array_distinct("terms")).alias("term"))
    small = asked.count() <= broadcast_terms
    put = F.broadcast if small else (lambda df: df)
    hit = posts.join(put(asked.select("term").distinct()), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    stats = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.greatest(F.lit(FLOOR), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    placed = hit.repartition("doc_id") if small else hit
    scored = placed.join(dl, "doc_id").join(put(weighted), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("met"), F.first("n_terms").alias("n_terms"))
    full = F.col("met") == F.col("n_terms")
    if conjunctive is True:
        scored = scored.where(full)
    elif conjunctive is None:
        any_full = scored.groupBy("query_id").agg(F.max(full).alias("any_full"))
        scored = scored.join(any_full, "query_id").where(full | ~F.col("any_full"))
    return ranked(scored.select("query_id", "doc_id", F.round("score", 9).alias("score")), limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best limit of each query; Spark keeps only these of each part before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def normalized(vector: Column) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = lambda own: F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    scaled = lambda own: F.get(F.transform(F.array(norm(own)), lambda n: F.transform(own, lambda x: x / n)), F.lit(0))
    return F.get(F.transform(F.array(v), scaled), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, vectors: DataFrame, limit: int, most_queries: int = 1000) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine of queries (query_id, q) and vectors (doc_id, v), the best vector of
    each document. Null vectors and ids are left out.

    All queries are searched, in hashed blocks of about most_queries (or more rows of equal ids), which go along with
    the tasks. A batch of vectors is one matrix product with the block, and only its best limit documents a query leave
    it: a document that is among the best of all is among the best of the batch with its best vector.
    """
    n = max(1, -(-queries.count() // most_queries))
    asked = queries.where(F.col("q").isNotNull()).select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block"))
    own = vectors.where(F.col("v").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    kinds = {f.name: f.dataType for f in [*queries.schema.fields, *vectors.schema.fields]}
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("doc_id", kinds["doc_id"]), T.StructField("score", T.DoubleType())])

    def found(i: int) -> DataFrame:
        block = asked.where(F.col("block") == i).orderBy("query_id").toArrow()
        box = queries.sparkSession.sparkContext.broadcast((block["query_id"].combine_chunks(), _rows(block["q"].combine_chunks())))

        def run(batches):
            ids, q = box.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from _best(ids, q, batch, limit)

        best = own.mapInArrow(run, schema).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        return ranked(best, limit)

    return reduce(DataFrame.union, [found(i) for i in range(n)])


def _rows(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix, each of length one."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    return rows / (np.sqrt((rows * rows).sum(1, keepdims=True)) + 1e-9)


def _best(ids: pa.Array, q: np.ndarray, batch: pa.RecordBatch, limit: int):
    """For each query the limit best documents of the batch, ties by document; a part of the queries at once."""
    docs, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(docs)))
    v = _rows(batch.column(1))[order]
    for part in range(0, len(q), 256):
        own = np.round(np.maximum.reduceat(v @ q[part : part + 256].T, starts, axis=0), 9)
        few = min(limit, len(docs))
        top = np.argsort(-own, axis=0, kind="stable")[:few]
        number = np.repeat(np.arange(own.shape[1])[None], few, 0)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(part + number.ravel())), pa.array(docs[top.ravel()], batch.schema.field(0).type), pa.array(own[top.ravel(), number.ravel()])], names=["query_id", "doc_id", "score"])


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists (query_id, doc_id, rank from 1): score is the sum of weight / (k + rank); equal
    scores go by list, then rank."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("query_id", "doc_id", F.lit(i).alias("list"), "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    both = reduce(DataFrame.union, parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("list", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "at.list", "at.rank", "doc_id"))
    return both.select("query_id", "doc_id", "score", rank.alias("rank"))


def fuse(lexical: DataFrame, semantic: DataFrame, mode: str = "disjoint", dense_weight: float = 0.5, k: int = 60) -> DataFrame:
    """disjoint: documents of the lexical list leave the dense one, which is ranked anew, before they are fused with
    the weight; overlap: both lists as they are, with equal weights."""
    if mode == "overlap":
        return rrf([lexical, semantic], k=k)
    rest = semantic.join(lexical.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return rrf([lexical, rest], [1.0, dense_weight], k)


def first_titles(ranked_rows: DataFrame, title: str = "title") -> DataFrame:
    """The first of equal titles in each query, ranked anew."""
    key = F.trim(F.lower(F.coalesce(F.col(title), F.lit(""))))
    first = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    kept = ranked_rows.withColumn("first", first).where("first = 1").drop("first")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def pinned(queries: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """Documents that a question names by identifier, in tiers: articles, standards, advisories (in the content), and
    commands (in the title); (query_id, doc_id, tier, rank). docs: id, doc_id, title, content."""
    each = lambda pattern, form: F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), form)))
    named = queries.select("query_id", F.lit(0).alias("tier"), each(ARTICLE, F.upper).alias("key")).union(queries.select("query_id", F.lit(1), each(STANDARD, lambda x: F.concat(F.lit("rfc"), x))))
    by_id = named.join(docs.select("id", "doc_id"), F.col("key") == F.col("doc_id")).select("query_id", "tier", "id", "doc_id")
    asked = queries.select("query_id", each(ADVISORY, F.upper).alias("key"))
    has = docs.select("id", "doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(ADVISORY), F.lit(1)), F.upper))).alias("key"))
    by_advisory = asked.join(has, "key").select("query_id", F.lit(2).alias("tier"), "id", "doc_id")
    asked = queries.select("query_id", each(COMMAND, lambda x: x).alias("key"))
    has = docs.select("id", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(COMMAND), F.lit(1)))).alias("key"))
    by_command = asked.join(has, "key").select("query_id", F.lit(3).alias("tier"), "id", "doc_id")
    found = by_id.union(by_advisory).union(by_command).groupBy("query_id", "id", "doc_id").agg(F.min("tier").alias("tier"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "id"))
    return found.withColumn("rank", rank).where((F.col("rank") <= limit) | (F.col("tier") <= 1)).select("query_id", "doc_id", "tier", "rank")


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, limit: int, weights: dict[str, float] | None = None, mode: str = "disjoint") -> DataFrame:
    """(query_id, doc_id, rank): identifiers first, then fused BM25 (three times what is needed) and dense ranks, equal
    titles once. queries: query_id, text, and q if vectors are given; docs: id, doc_id, title, keywords, content;
    vectors: doc_id, v."""
    weights = weights or {"title": 10.0, "keywords": 5.0, "content": 1.0}
    first = pinned(queries, docs, limit)
    asked = queries.select("query_id", query_terms(F.col("text")).alias("terms"))
    lexical = bm25(asked, postings(docs, weights), lengths(docs, list(weights)), 3 * limit)
    lexical = lexical.join(first, ["query_id", "doc_id"], "left_anti").join(docs.select("doc_id", "title"), "doc_id")
    lexical = first_titles(lexical).select("query_id", "doc_id", "rank")
    fused = fuse(lexical, dense(queries, vectors, limit).select("query_id", "doc_id", "rank"), mode) if vectors is not None else lexical
    fused = fused.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rows = first.select("query_id", "doc_id", "rank").union(fused.select("query_id", "doc_id", F.col("rank") + 1_000_000)).join(docs.select("doc_id", "title"), "doc_id")
    return first_titles(rows).where(F.col("rank") <= limit).select("query_id", "doc_id", "rank")


def prefix_search(queries: DataFrame, docs: DataFrame, fields: dict[str, float], limit: int = 3, shortest: int = 2) -> DataFrame:
    """Full-text search by word beginnings over a small index: documents (doc_id and the fields) with words that begin
    with every term of a question, or with any where none has all; the best limit by weighted words. Words meet terms
    by their first characters (as many as the shortest term may have), so that the join is on equal keys."""
    asked = queries.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("asked")).where(F.length("asked") >= shortest)
    posts = postings(docs, fields)
    met = posts.join(asked, (F.substring("term", 1, shortest) == F.substring("asked", 1, shortest)) & F.col("term").startswith(F.col("asked")))
    per = met.groupBy("query_id", "doc_id", "n_terms", "asked").agg(F.sum("tf").alias("tf"))
    scored = per.groupBy("query_id", "doc_id", "n_terms").agg(F.sum(F.col("tf") / (F.col("tf") + 1)).alias("score"), F.count("*").alias("met"))
    full = F.col("met") == F.col("n_terms")
    any_full = scored.groupBy("query_id").agg(F.max(full).alias("any_full"))
    kept = scored.join(any_full, "query_id").where(full | ~F.col("any_full"))
    return ranked(kept.select("query_id", "doc_id", F.round("score", 9).alias("score")), limit)


def contains_filter(rows: DataFrame, text: str, columns: list[str], kind: str | None = None) -> DataFrame:
    """Rows one of whose columns has the text, whatever its case, of one kind if given."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns])
    return rows.where(hit if kind is None else hit & (F.col("kind") == kind))


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A bag of hashed words as a vector of length one: a stand-in for an embedding model, for tests and dry runs."""
    places = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counted = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda p: p == i)).cast("double"))
    # each step is bound by a lambda, so that it is worked out once a text
    return F.get(F.transform(F.transform(F.array(places), counted), normalized), F.lit(0))


def embedding_input(title: Column, content: Column, most: int = 6000) -> Column:
    return F.concat(F.lit("search_document: "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, most))
