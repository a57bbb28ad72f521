"""Log analytics over the events table, seen as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import collapse as C
from brindle.operators import rules as R
from brindle.operators import search as S
from brindle.plans.registry import query, table

RULES = """
rules:
  - {name: many_errors, severity: critical, category: app, patterns: [{regex: "^error"}]}
  - {name: sales, severity: info, category: app, patterns: [{regex: "purchase"}, {msg_code: "0000002"}]}
  - {name: views, severity: warning, category: web, patterns: [{regex: "VIEW"}]}
  - {name: never, severity: critical, category: web, patterns: [{regex: "no such thing"}]}
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("CASE event_type WHEN 'error' THEN 'err' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'notice' WHEN 'click' THEN 'info' ELSE 'debug' END")
    e = table(spark, sf_dir, "events").withColumn("severity", severity)
    message = F.concat_ws(" ", "event_type", "props")
    return e.select(
        F.col("event_id").alias("id"), "ts", "severity", S.severity_number(F.col("severity")).alias("severity_num"), F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")).alias("process"),
        F.lpad(F.lower(F.hex(F.col("user_id"))), 8, "0").alias("msg_code"), F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("hostname"),
        F.concat(F.lit("log"), (F.col("event_id") % 3).cast("string")).alias("source_file"), message.alias("message"), message.alias("raw_line"), "user_id", "value",
    )


LOGS = """WITH logs AS (SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'err' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'notice' WHEN 'click' THEN 'info' ELSE 'debug' END AS severity,
 CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 WHEN 'click' THEN 6 ELSE 7 END AS severity_num, 'app' || (user_id % 7) AS process,
 lpad(lower(to_hex(user_id)), 8, '0') AS msg_code, 'host' || (user_id % 5) AS hostname, 'log' || (event_id % 3) AS source_file, concat_ws(' ', event_type, props) AS message, user_id, value FROM events) """


@query(LOGS + "SELECT id, ts, severity, process, message, count(*) OVER () AS total, count(*) OVER () > 30 AS capped FROM logs WHERE ts >= '2024-01-05' AND ts <= '2024-01-20' AND severity_num <= 5 AND process = 'app3' ORDER BY ts, id LIMIT 20 OFFSET 10")
def log_filter_page(spark, sf_dir):
    found = S.search_page(logs(spark, sf_dir), 20, 10, start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", max_severity=5, process="app3")
    return found.select("id", "ts", "severity", "process", "message", "total", "capped")


@query(LOGS + "SELECT count(*) AS n FROM logs WHERE lower(msg_code) LIKE '0000002%' AND lower(source_file) LIKE 'log1%' AND list_contains(regexp_split_to_array(lower(message), '[^\\p{L}\\p{N}_]+'), 'click')")
def log_count(spark, sf_dir):
    return S.filtered(logs(spark, sf_dir), msg_code="0000002", source_file="LOG1", search="click!").agg(F.count("*").alias("n"))


@query(LOGS + "SELECT id, ts, message, CASE WHEN total > 500 THEN 'newest 500 of ' || total || ' rows' END AS note FROM (SELECT *, count(*) OVER () AS total FROM logs) ORDER BY ts DESC, id DESC LIMIT 500")
def log_newest_capped(spark, sf_dir):
    return S.newest(logs(spark, sf_dir), 500).select("id", "ts", "message", "note")


@query(LOGS + "SELECT severity, count(*) AS n, min(severity_num) AS severity_num FROM logs GROUP BY 1")
def severity_summary(spark, sf_dir):
    return S.severity_summary(logs(spark, sf_dir))


@query(LOGS + "SELECT process, count(*) AS n FROM logs GROUP BY 1")
def process_summary(spark, sf_dir):
    return S.count_by(logs(spark, sf_dir), "process")


@query(LOGS + "SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM logs GROUP BY 2 UNION ALL SELECT 'process', process, count(*) FROM logs GROUP BY 2 UNION ALL SELECT 'source', source_file, count(*) FROM logs GROUP BY 2")
def facets(spark, sf_dir):
    return S.facets(logs(spark, sf_dir))


@query(LOGS + "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM logs")
def time_range(spark, sf_dir):
    return S.time_range(logs(spark, sf_dir))


@query(LOGS + "SELECT msg_code, count(*) AS n, arg_min(message, id) AS sample FROM logs GROUP BY 1 ORDER BY n DESC, msg_code LIMIT 25")
def top_codes_sample(spark, sf_dir):
    return S.top_codes(logs(spark, sf_dir), 25)


@query(LOGS + "SELECT hostname, count(*) AS n, min(id) AS first_id FROM logs GROUP BY 1 ORDER BY n DESC, first_id LIMIT 1")
def mode_host(spark, sf_dir):
    return S.common_host(logs(spark, sf_dir))


_FOUND = """, hits AS (SELECT 'many_errors' AS rule, 0 AS pattern, * FROM logs WHERE regexp_matches(message, '^error', 'i') UNION ALL SELECT 'sales', 0, * FROM logs WHERE regexp_matches(message, 'purchase', 'i')
 UNION ALL SELECT 'sales', 1, * FROM logs WHERE starts_with(lower(msg_code), '0000002') UNION ALL SELECT 'views', 0, * FROM logs WHERE regexp_matches(message, 'VIEW', 'i')) """


@query(LOGS + _FOUND + "SELECT rule, hits, first_seen, last_seen, CASE rule WHEN 'many_errors' THEN 'critical' WHEN 'sales' THEN 'info' ELSE 'warning' END AS severity, sample_ids FROM (SELECT rule, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen, list(id ORDER BY ts, id, pattern)[1:5] AS sample_ids FROM hits GROUP BY rule)")
def rule_findings(spark, sf_dir):
    rules = R.load_rules(RULES)
    found = R.ordered(R.simple_findings(logs(spark, sf_dir), rules), rules)
    return found.select("rule", "hits", "first_seen", "last_seen", "severity", F.col("samples.id").alias("sample_ids"))


@query("""WITH RECURSIVE g AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts, event_id) FILTER (event_type = 'error') AS a, list(epoch_us(ts) ORDER BY ts, event_id) FILTER (event_type = 'signup') AS b FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1),
 w AS (SELECT user_id, a, b, 1 AS i, 1 AS j, 0 AS p FROM g UNION ALL SELECT user_id, a, b,
  CASE WHEN abs(b[j] - a[i]) < 7200000000 OR a[i] <= b[j] THEN i + 1 ELSE i END, CASE WHEN abs(b[j] - a[i]) < 7200000000 OR a[i] > b[j] THEN j + 1 ELSE j END, CASE WHEN abs(b[j] - a[i]) < 7200000000 THEN p + 1 ELSE p END
  FROM w WHERE i <= coalesce(len(a), 0) AND j <= coalesce(len(b), 0))
 SELECT user_id, max(p)::BIGINT AS pairs, any_value(coalesce(len(a), 0))::BIGINT AS n_first, any_value(coalesce(len(b), 0))::BIGINT AS n_second FROM w GROUP BY 1""")
def paired_flap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return R.paired_counts(e, F.col("event_type") == "error", F.col("event_type") == "signup", 7200, ["user_id"])


@query("SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 7200000000")
def paired_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return R.pair_candidates(e, F.col("event_type") == "error", F.col("event_type") == "signup", 7200, ["user_id"])


@query("SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber, arg_min(l_returnflag, p) AS l_returnflag, min(p) AS first_position FROM (SELECT *, l_orderkey * 10 + l_linenumber AS p FROM lineitem) GROUP BY 1")
def replica_collapse(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return C.collapse(r, "l_suppkey", ["l_quantity", "l_linenumber"], ["l_returnflag"], "p")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS resources FROM lineitem GROUP BY 1")
def resource_summary(spark, sf_dir):
    return C.resource_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey")


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def top_busiest(spark, sf_dir):
    return C.busiest(table(spark, sf_dir, "part"), "p_size", 20, "p_partkey").select("p_partkey", "p_name", "p_size")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'never' ELSE epoch(o_orderdate)::BIGINT::VARCHAR END AS expiry FROM orders ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 9223372036854775807 ELSE epoch(o_orderdate)::BIGINT END, o_orderkey LIMIT 25")
def soonest_expiring(spark, sf_dir):
    expiry = F.when(F.col("o_orderkey") % 5 == 0, "never").otherwise(F.unix_timestamp("o_orderdate").cast("string"))
    return C.soonest(table(spark, sf_dir, "orders").select("o_orderkey", expiry.alias("expiry")), "expiry", 25, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE greatest(coalesce(try_cast(l_tax * 100 AS BIGINT), 0), CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0")
def interfaces_with_errors(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").withColumn("c1", F.round(F.col("l_tax") * 100)).withColumn("c2", F.when(F.col("l_returnflag") == "R", "1").otherwise("bad"))
    return C.with_errors(r, ["c1", "c2"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


@query("SELECT n_name AS name, row_number() OVER (ORDER BY k, a, b, n_name) AS place FROM (SELECT n_regionkey || '.' || n_nationkey AS n_name, 0 AS k, n_regionkey AS a, n_nationkey AS b FROM nation UNION ALL SELECT 'mgmt', 1, NULL, NULL UNION ALL SELECT r_name, 2, NULL, NULL FROM region UNION ALL SELECT '', 3, NULL, NULL)")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "nation").select(F.concat_ws(".", "n_regionkey", "n_nationkey").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).union(spark.sql("SELECT 'mgmt' UNION ALL SELECT ''"))
    return names.select("name", F.row_number().over(Window.orderBy(*C.natural_order("name"))).cast("long").alias("place"))
