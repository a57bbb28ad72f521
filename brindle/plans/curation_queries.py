"""Configuration views, entities and gold checks on texts that are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import config_view as V
from brindle.operators import entities as N
from brindle.operators import retrieval as R
from brindle.plans.registry import query, table


def _config(spark, sf_dir):
    """A configuration for each region: a pool for each nation with its suppliers as members, and a virtual server for
    two nations of three."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    members = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda k: F.format_string("        /Common/s%d:80 {\n            address 10.0.0.%d\n        }", k, k)), "\n").alias("members"))
    pool = F.format_string("ltm pool /Common/%s {\n    members {\n%s\n    }\n    monitor /Common/http\n}\n", name, "members")
    server = F.when(F.col("n_nationkey") % 3 > 0, F.format_string("ltm virtual /Common/vs_%s {\n    destination /Common/10.1.0.%d:443\n    pool /Common/%s\n    profiles {\n        /Common/tcp { }\n    }\n}\n", name, F.col("n_nationkey"), name)).otherwise("")
    rows = n.join(members, "n_nationkey").select(F.col("n_regionkey").cast("string").alias("source"), "n_nationkey", F.concat(pool, server).alias("part"))
    return rows.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "part"))), lambda x: x["part"]), "").alias("text"))


@query("SELECT n_regionkey::VARCHAR AS source, '/Common/' || replace(n_name, ' ', '_') AS path, '/Common/http' AS monitor, list('10.0.0.' || s_suppkey ORDER BY s_suppkey) AS addresses FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def config_pools(spark, sf_dir):
    return V.pools(_config(spark, sf_dir)).select("source", "path", "monitor", F.col("members.address").alias("addresses"))


@query("SELECT DISTINCT n_regionkey::VARCHAR AS source, 'vs_' || replace(n_name, ' ', '_') AS name, '/Common/10.1.0.' || n_nationkey || ':443' AS destination, '/Common/' || replace(n_name, ' ', '_') AS pool FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 > 0")
def config_apps(spark, sf_dir):
    return V.apps(V.objects(_config(spark, sf_dir)), "Common").select("source", "name", "destination", "pool")


@query("SELECT n_regionkey::VARCHAR AS source, '/Common/s' || s_suppkey || ':80' AS member, CASE WHEN n_nationkey % 3 > 0 THEN '/Common/vs_' || replace(n_name, ' ', '_') ELSE '(none)' END AS server FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains('/Common/s' || s_suppkey || ':80', 's1')")
def config_chain(spark, sf_dir):
    texts = _config(spark, sf_dir)
    return V.chain(V.pools(texts), V.virtual_servers(texts), "s1").select("source", "member", "server")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'K' || doc_id ELSE 'K00' || doc_id END AS expected, CASE WHEN found THEN 'K' || doc_id END AS doc_id, CASE WHEN found AND doc_id % 2 = 0 THEN 'exact' WHEN found THEN 'normalised' ELSE 'missing' END AS how FROM (SELECT doc_id + 1 AS doc_id, doc_id + 1 IN (SELECT doc_id + 1 FROM labels) AS found FROM documents)")
def gold_validation(spark, sf_dir):
    q = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") + 1).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.when(F.col("doc_id") % 2 == 0, "K").otherwise("K00"), F.col("doc_id").cast("string")).alias("expected"))
    return N.validated_gold(q, table(spark, sf_dir, "labels").select(F.concat(F.lit("K"), (F.col("doc_id") + 1).cast("string")).alias("doc_id")))


@query("SELECT page_id, CASE WHEN contains(url, 'page=') THEN 'paged' WHEN contains(url, '/fr/') OR contains(url, '/de/') THEN 'foreign' WHEN contains(url, '/en/') THEN 'english' ELSE 'other' END AS bucket FROM pages")
def slug_classes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.slug_class(F.col("url"), {"paged": ["page="], "foreign": ["/fr/", "/de/"], "english": ["/en/"]}).alias("bucket"))


_STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'HTTP::uri LB::x' ELSE array_to_string(list_filter(regexp_split_to_array(lower(trim(replace(text, '::', ' '))), '\\s+'), lambda w: w NOT IN ({_STOP}) AND w <> '')[1:5], ' ') END AS q FROM conversations")
def code_queries(spark, sf_dir):
    """Every second turn speaks of commands."""
    text = F.replace("text", F.lit("::"), F.lit(" "))
    asked = F.when(F.col("turn") % 2 == 1, F.concat(text, F.lit(" HTTP::uri and LB::x or HTTP::uri?"))).otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.code_query(asked, R.STOP_WORDS).alias("q"))


@query("SELECT 'operator' AS kind, op AS token FROM (SELECT unnest(['~', '!', '*', '/', '%', '+', '-', '<<', '>>', '<', '>', '<=', '>=', '==', '!=', 'eq', 'ne', '&', '^', '|', '&&', '||']) AS op) WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, op))")
def rulebook_symbols(spark, sf_dir):
    from brindle.functions.text import SYMBOL_OPERATORS

    return N.rulebook(table(spark, sf_dir, "documents")).where(F.col("token").isin(*SYMBOL_OPERATORS))
