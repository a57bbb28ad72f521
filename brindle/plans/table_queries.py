"""Keyed tables, curation, joins and graph queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import curate as Q
from brindle.operators import tables as T
from brindle.plans.registry import query, table


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def retention(spark, sf_dir):
    return T.retained(table(spark, sf_dir, "events"), "ts", now(), 10).select("event_id", "ts", "event_type")


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, sf_dir):
    return T.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ts", "event_type")


@query("""WITH c AS (SELECT doc_id, md5(text) AS hash, source FROM documents WHERE doc_id % 3 > 0), i AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(text || '!') ELSE md5(text) END AS hash, 'new' AS source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
 SELECT doc_id, coalesce(CASE WHEN take THEN ih ELSE ch END) AS hash, CASE WHEN take THEN isrc ELSE csrc END AS source, CASE WHEN take AND old THEN 'updated' WHEN take THEN 'inserted' WHEN new THEN 'unchanged' ELSE 'kept' END AS outcome
 FROM (SELECT coalesce(c.doc_id, i.doc_id) AS doc_id, c.hash AS ch, i.hash AS ih, c.source AS csrc, i.source AS isrc, c.doc_id IS NOT NULL AS old, i.doc_id IS NOT NULL AS new, i.doc_id IS NOT NULL AND NOT coalesce(c.hash = i.hash, false) AS take FROM c FULL JOIN i ON c.doc_id = i.doc_id)""")
def document_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    old = d.where("doc_id % 3 > 0").select("doc_id", F.md5("text").alias("hash"), "source", t.alias("created_at"), t.alias("last_fetched"))
    new = d.where("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"), F.lit("new").alias("source"))
    return T.upsert(old, new, "doc_id", now(), "hash").select("doc_id", "hash", "source", "outcome")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def orphan_anti(spark, sf_dir):
    return T.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT u.user_id FROM (SELECT DISTINCT user_id + 20 AS user_id FROM events) u LEFT JOIN (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY 1) s USING (user_id) WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-31' - INTERVAL 3 DAY")
def ttl_stale(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return T.stale(e.select((F.col("user_id") + 20).alias("user_id")).distinct(), state, "user_id", "ts", now(), 3)


@query("SELECT doc_id, md5(text) AS hash, ceil(n_chars / 2700)::BIGINT AS n_chunks, doc_id % 5 > 0 AND doc_id % 7 > 0 AS reuse FROM documents")
def incremental_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"), F.ceil(F.col("n_chars") / 2700).cast("long").alias("n_chunks"))
    index = d.where("doc_id % 5 > 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("hash")))
    return T.reuse_vectors(d, index)


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation), r(node, steps) AS (SELECT 24, 0 UNION SELECT e.b, r.steps + 1 FROM r JOIN e ON e.a = r.node WHERE r.steps < 12) SELECT node, min(steps) AS steps FROM r GROUP BY 1")
def event_graph_reach(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b")).union(n.select("n_nationkey", "n_regionkey"))
    return T.reach(edges, spark.sql("SELECT 24 AS node"))


@query("SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 14400000000 THEN 1 ELSE 0 END AS new FROM events)")
def session_gap(spark, sf_dir):
    return T.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 14400).select("event_id", "session")


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_prop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT s_name, coalesce(n_name, '(none)') AS nation, coalesce(r_name, '(none)') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 3 > 0 LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 0")
def object_chain(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    chain = s.join(n.where("n_nationkey % 3 > 0"), s["s_nationkey"] == n["n_nationkey"], "left").join(r.where("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return chain.select("s_name", F.coalesce("n_name", F.lit("(none)")).alias("nation"), F.coalesce("r_name", F.lit("(none)")).alias("region"))


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders, coalesce(items, []) AS items FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, list(o_orderkey || ':' || l_linenumber ORDER BY o_orderkey, l_linenumber)[1:5] AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey")
def app_view(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    own = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o_orderkey", "l_linenumber"))), 1, 5), lambda x: F.concat_ws(":", x["o_orderkey"], x["l_linenumber"])).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    return c.join(own, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("items", none).alias("items"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, arg_max(role, turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL) WHERE back <= 3 AND last = 'user'")
def chat_last_n(spark, sf_dir):
    return Q.last_turns(table(spark, sf_dir, "conversations"), 3)


@query("SELECT conv_id, md5('<|system|>' || chr(10) || 'be brief' || chr(10) || string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn, '<|' || role || '|>' || chr(10) || text)) AS text FROM conversations GROUP BY 1")
def train_text(spark, sf_dir):
    return Q.training_text(table(spark, sf_dir, "conversations"), "be brief").select("conv_id", F.md5("text").alias("text"))


@query("SELECT doc_id, quality, toxic FROM labels JOIN documents USING (doc_id) WHERE (n_chars % 100) / 100.0::DOUBLE >= 0.7 AND quality = 1")
def grade_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    judge = F.struct(F.struct((F.col("n_chars") % 100 / 100.0).alias("overall")).alias("scores"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"))
    return Q.retained(rows.withColumn("judge", judge)).select("doc_id", "quality", "toxic")


@query("SELECT part, count(*) AS n, min(doc_id) AS least FROM (SELECT doc_id, CASE WHEN ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9 THEN 'train' ELSE 'eval' END AS part FROM documents) GROUP BY 1")
def train_eval_split(spark, sf_dir):
    return Q.split_by_hash(table(spark, sf_dir, "documents"), F.col("doc_id"), 0.9).groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id)) AS k FROM documents) WHERE k <= 5")
def seeded_sample(spark, sf_dir):
    return Q.seeded_sample(table(spark, sf_dir, "documents"), F.col("doc_id"), 5, ["source"]).select("doc_id", "source")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 10 ORDER BY k, lang, doc_id LIMIT 35")
def tag_quotas(spark, sf_dir):
    return Q.quotas(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 10, 35)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN ['A::one', 'B::two'] WHEN 2 THEN ['B::two'] ELSE [] END AS missing FROM documents")
def grounding_subset(spark, sf_dir):
    """Commands of questions and answers that the context, or the list of known ones, lacks."""
    k = F.col("doc_id") % 3
    context = F.when(k == 0, "A::one and B::two").when(k == 1, "none").otherwise("B::two, A::one")
    known = F.when(k == 2, F.array(F.lit("A::one"))).otherwise(F.expr("cast(array() as array<string>)"))
    missing = Q.ungrounded(F.lit("What is A::one?"), F.lit("It calls B::two."), context, known)
    return table(spark, sf_dir, "documents").select("doc_id", missing.alias("missing"))


@query("SELECT r_name AS partition, list_sort(list(n_name)) AS apps FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def apps_by_partition(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("partition")).agg(F.sort_array(F.collect_list("n_name")).alias("apps"))


@query("SELECT 'inserted' AS outcome, count(*) FILTER (doc_id % 3 = 0) AS n FROM documents UNION ALL SELECT 'updated', count(*) FILTER (doc_id % 3 > 0) FROM documents")
def ingest_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"))
    return T.outcomes(T.upsert_by_url(d.where("doc_id % 3 > 0"), d))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE (o_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tasks = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderkey")
    return T.unanswered(tasks, li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"]).select("o_orderkey", "l_linenumber")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT event_id, CASE WHEN last IS NULL THEN 'none' ELSE last END AS last_error_value FROM (SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM events)")
def as_of_last(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("event_type") == "error", F.col("event_id").cast("string")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(last, F.lit("none")).alias("last_error_value"))
