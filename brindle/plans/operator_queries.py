"""Operators on inputs made from the driver's tables in such a way that SQL tells what must come out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from brindle.functions import logs as L
from brindle.functions import prompts as P
from brindle.functions import stanzas as Z
from brindle.functions import text as X
from brindle.operators import collapse as C
from brindle.operators import config_view as V
from brindle.operators import curate as Q
from brindle.operators import entities as N
from brindle.operators import evaluate as E
from brindle.operators import retrieval as R
from brindle.operators import tables as T
from brindle.plans.curation_queries import _config
from brindle.plans.registry import query, table
from brindle.sources import archives as A
from brindle.sources import documents as D
from brindle.sources import sinks as S


def case(column: str, *values):
    """The value at the column's place among them, as a plain CASE."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.expr(column) == i, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
    return out


# --- filters and guards ---


@query("SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN '.crt.1' WHEN 1 THEN '.crt' ELSE '.crt.x' END AS name FROM supplier WHERE s_suppkey % 3 > 0")
def not_bundled(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", case("s_suppkey % 3", ".crt.1", ".crt", ".crt.x")).alias("name"))
    return C.not_bundled(rows, "name")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/Common/' || s_name WHEN 1 THEN '/x/' || s_name END AS full_name FROM supplier")
def name_guards(spark, sf_dir):
    name = F.when(F.expr("s_suppkey % 3 = 0"), F.concat(F.lit("/Common/"), "s_name")).when(F.expr("s_suppkey % 3 = 1"), F.concat(F.lit("  /x/"), "s_name", F.lit(" "))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").withColumn("name", name).select("s_suppkey", C.partitioned_name("name").alias("full_name"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'commands' WHEN 2 THEN 'events' WHEN 3 THEN 'mislabelled' WHEN 4 THEN 'deprecated' WHEN 5 THEN 'commands' END AS reason FROM documents")
def curation_reasons(spark, sf_dir):
    """Questions whose command or event isn't in the context, calls an event a command, or rests on an old context; and
    one whose command isn't known."""
    known = F.array(F.lit("HTTP::host"), F.lit("HTTP::uri"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", case("doc_id % 6", "What does HTTP::host do?", "What does HTTP::uri do?", "What does LB_FAILED do?", "What is the HTTP_REQUEST command?", "What does HTTP::host do?", "What does IP::addr do?").alias("question"),
        F.lit("It tells the name.").alias("answer"),
        case("doc_id % 6", "HTTP::host when HTTP_REQUEST {", "HTTP::host when HTTP_REQUEST {", "when HTTP_REQUEST {", "when HTTP_REQUEST {", "HTTP::host is Deprecated", "IP::addr when HTTP_REQUEST {").alias("context"),
    )
    return Q.reasons(rows, known).select("doc_id", "reason")


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), '1') OR contains(lower(p_brand), '1')) AND p_type = (SELECT min(p_type) FROM part)")
def reference_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = part.agg(F.min("p_type")).first()[0]
    return R.contains_filter(part.withColumn("kind", F.col("p_type")), "1", ["p_name", "p_brand"], kind).select("p_partkey", "p_name")


@query("SELECT event_id, event_id % 4 IN (1, 2) AS skipped FROM events")
def skipped_logs(spark, sf_dir):
    name = case("event_id % 4", "ltm", "wtmp", "journal.1", "audit.log")
    return table(spark, sf_dir, "events").select("event_id", A.skipped_log(name).alias("skipped"))


@query("SELECT page_id, CASE page_id % 4 WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS skipped FROM pages")
def content_types(spark, sf_dir):
    kind = F.when(F.expr("page_id % 4 = 0"), "text/html; charset=utf-8").when(F.expr("page_id % 4 = 2"), "image/png").when(F.expr("page_id % 4 = 3"), "application/pdf")
    return table(spark, sf_dir, "pages").select("page_id", X.skipped_content_type(kind).alias("skipped"))


@query("SELECT conv_id, turn, substr(regexp_replace(text, '[<>]', '', 'g'), 1, 40) AS cut, CASE WHEN role IN ('user', 'system') THEN role ELSE 'user' END AS role FROM conversations")
def input_limits(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.limited(F.col("text"), 40).alias("cut"), P.one_of(F.col("role"), ["user", "system"], "user").alias("role"))


# --- joins and views ---


@query("SELECT n_regionkey::VARCHAR AS source, '/Common/vs_' || replace(n_name, ' ', '_') AS path, '/Common/' || replace(n_name, ' ', '_') AS pool, '/Common/http' AS monitor FROM nation WHERE n_nationkey = 1 AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def app_details(spark, sf_dir):
    name = table(spark, sf_dir, "nation").where("n_nationkey = 1").first()["n_name"].replace(" ", "_")
    return V.app_details(V.objects(_config(spark, sf_dir)), f"/Common/vs_{name}").select("source", "path", "pool", "monitor")


@query("SELECT DISTINCT n_regionkey::VARCHAR AS source, 'Common' AS partition FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def config_partitions(spark, sf_dir):
    return V.partitions(V.objects(_config(spark, sf_dir)))


@query("SELECT item_id AS qid, 'open' AS condition, text AS question, 'one ' || item_id AS X, 'two ' || item_id AS Y FROM benchmark WHERE item_id % 4 > 0")
def answer_packets(spark, sf_dir):
    """Questions of which one in four lacks a model's answer."""
    items = table(spark, sf_dir, "benchmark")
    each = items.select(F.col("item_id").alias("qid"), F.lit("open").alias("condition"), F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model"))
    each = each.where("model = 'm1' OR qid % 4 > 0").withColumn("answer", F.concat_ws(" ", F.when(F.col("model") == "m1", "one").otherwise("two"), "qid"))
    return E.packets(items.select(F.col("item_id").alias("qid"), F.col("text").alias("question")), each, {"X": "m1", "Y": "m2"})


@query("""SELECT item_id AS packet_id, 'c' AS condition, CASE WHEN (item_id % 2 = 0) = (l = 'X') THEN 'm1' ELSE 'm2' END AS model, CASE l WHEN 'X' THEN item_id % 5 ELSE item_id % 7 END AS score, l = CASE WHEN item_id % 3 = 0 THEN 'X' ELSE 'Y' END AS best
 FROM benchmark, (SELECT unnest(['X', 'Y']) AS l)""")
def deanonymised(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    judged = items.select(F.col("item_id").alias("packet_id"), F.lit("c").alias("condition"), F.create_map(F.lit("X"), F.col("item_id") % 5, F.lit("Y"), F.col("item_id") % 7).alias("scores"), F.when(F.col("item_id") % 3 == 0, "X").otherwise("Y").alias("best"))
    letters = items.select(F.col("item_id").alias("packet_id"), F.explode(F.array(F.lit("X"), F.lit("Y"))).alias("letter"))
    mapping = letters.withColumn("model", F.when((F.col("packet_id") % 2 == 0) == (F.col("letter") == "X"), "m1").otherwise("m2"))
    return E.deanonymised(judged, mapping)


def _module_pages(spark, sf_dir):
    """A page for each region with a command for each nation, and detail pages for every second one."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    module = F.replace(F.upper("r_name"), F.lit(" "), F.lit("_"))
    name = F.format_string("%s::c%d", module, "n_nationkey")
    line = F.concat(F.lit("- "), name, F.lit(" - gives "), F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "\n  and more").otherwise(""))
    index = n.groupBy(module.alias("module")).agg(F.concat(F.lit("# m\n## Commands\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n## Events\n- E_"), F.first(module), F.lit(" - is fired\n"), F.lit("## Other\ntext")).alias("text"))
    text = F.format_string("# t\n## Description\nabout %d\n## Syntax\nsyn %d\n## Examples\nex %d\n\nmore\n## Valid Events\nA_ONE, B_TWO and C_THREE.\n", "n_nationkey", "n_nationkey", "n_nationkey")
    pages = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("http://h/"), X.entity_path(name)).alias("url"), text.alias("text"))
    return N.entities(index, pages, "http://h/")


_ENTITY = """e AS (SELECT upper(replace(r_name, ' ', '_')) AS module, 'command' AS kind, upper(replace(r_name, ' ', '_')) || '::c' || n_nationkey AS name, 'gives ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' and more' ELSE '' END AS summary, n_nationkey % 2 = 0 AS full_page, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT DISTINCT upper(replace(r_name, ' ', '_')), 'event', 'E_' || upper(replace(r_name, ' ', '_')), 'is fired', false, NULL FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("WITH " + _ENTITY + " SELECT module, kind, name, summary, 'http://h/' || replace(name, '::', '__') || '.html' AS source_url, CASE WHEN full_page THEN 'about ' || k END AS description, CASE WHEN full_page THEN 'syn ' || k END AS syntax, CASE WHEN full_page THEN ['ex ' || k, 'more'] END AS examples, CASE WHEN full_page THEN ['A_ONE', 'B_TWO', 'C_THREE'] END AS valid_events FROM e")
def module_entities(spark, sf_dir):
    return _module_pages(spark, sf_dir).select("module", "kind", "name", "summary", "source_url", "description", "syntax", "examples", "valid_events")


@query("WITH " + _ENTITY + " SELECT 'What does ' || name || ' do?' AS question, CASE WHEN full_page THEN 'about ' || k ELSE summary END AS answer FROM e UNION ALL SELECT 'What is the syntax of ' || name || '?', 'syn ' || k FROM e WHERE full_page UNION ALL SELECT 'Show an example of ' || name || '.', 'ex ' || k FROM e WHERE full_page UNION ALL SELECT 'In which events can ' || name || ' be used?', 'A_ONE, B_TWO, C_THREE' FROM e WHERE full_page")
def entity_questions(spark, sf_dir):
    return N.entity_questions(_module_pages(spark, sf_dir)).select("question", "answer")


@query("SELECT 'M' || p_partkey AS module FROM part WHERE p_partkey % 3 = 0")
def module_names(spark, sf_dir):
    """Urls of modules, twice each, among others."""
    url = case("p_partkey % 3", "http://h/x/M%s.html", "http://h/x/m%s.html", "http://h/M%s.htm")
    urls = table(spark, sf_dir, "part").select(F.replace(url, F.lit("%s"), F.col("p_partkey").cast("string")).alias("url"))
    return N.modules(urls.union(urls))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 OR s THEN n_nationkey END AS k, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 4 > 0 THEN 'base' ELSE CASE WHEN s THEN 'other' END END AS host, CASE WHEN s THEN n_name END AS site FROM (SELECT *, n_nationkey % 3 = 0 AS s FROM nation) WHERE n_nationkey % 2 = 0 OR s")
def merged_context(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    base = n.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 > 0, "base").otherwise("").alias("host"), F.lit(None).cast("string").alias("site"))
    return V.merged_context(base, n.where("k % 3 = 0").select("k", F.lit("other").alias("host"), F.col("n_name").alias("site")), "k", ["host", "site"])


# --- sums and orders ---


@query("SELECT event_type AS running_state, user_id % 3 AS status, count(*) AS n FROM events GROUP BY ALL")
def tenant_tallies(spark, sf_dir):
    return V.tallies(table(spark, sf_dir, "events").select(F.col("event_type").alias("running_state"), (F.col("user_id") % 3).alias("status")))


@query("SELECT count_if(s_suppkey % 4 > 0) || '/' || count(*) || ' ready' AS summary FROM supplier")
def cluster_readiness(spark, sf_dir):
    return V.readiness(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4 > 0).alias("ready")))


_PATHS = "CASE event_id % 3 WHEN 0 THEN 'q/tmstat/snapshots/blade' || event_id % 2 || '/perf/' || (event_id % 5) * 10 || '/s' || event_id WHEN 1 THEN 'q/tmstat/private/blade1-tmm' ELSE 'q/other/x' END"


@query("SELECT event_id, family, blade, type, stage FROM (SELECT event_id, event_id % 3 AS k, CASE event_id % 3 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'segment' END AS family, CASE event_id % 3 WHEN 0 THEN 'blade' || event_id % 2 WHEN 1 THEN 'blade1' END AS blade, CASE event_id % 3 WHEN 0 THEN 'perf' WHEN 1 THEN 'tmm' END AS type, CASE event_id % 3 WHEN 0 THEN ((event_id % 5) * 10)::VARCHAR WHEN 1 THEN '' END AS stage FROM events)")
def snapshot_paths(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("event_id", "p.family", "p.blade", "p.type", F.col("p.interval").alias("stage"))


def _python(function, kind):
    """A parser of single texts, over Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([function(t) for t in texts], dtype=object)

    return F.pandas_udf(run, kind)


def _snapshots(spark, sf_dir):
    path = _python(Z.snapshot_path, "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", path(F.expr(_PATHS.replace("'q/tmstat/snapshots/blade' || event_id % 2 ||", "'q/tmstat/snapshots/blade' || (event_id % 2) ||"))).alias("p"))


@query("SELECT count_if(event_id % 3 < 2) AS n, ['segment', 'snapshot'] AS familys, ['blade0', 'blade1'] AS blades, ['perf', 'tmm'] AS types, ['0', '10', '20', '30', '40'] AS intervals FROM events")
def snapshot_coverage(spark, sf_dir):
    return C.coverage(_snapshots(spark, sf_dir).where("p is not null").select("p.family", "p.blade", "p.type", "p.interval"))


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 > 0 AND item_id % 5 = 0")
def recovered_queries(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit("lexical"), F.lit("hybrid"))).alias("method"))
    hit = F.when(F.col("method") == "lexical", F.expr("if(query_id % 3 = 0, 1.0D, 0.0D)")).otherwise(F.expr("if(query_id % 5 = 0, 1.0D, 0.0D)"))
    return E.recovered(items.withColumn("hit10", hit), "lexical", "hybrid")


@query("SELECT round(count_if(doc_id % 4 > 0) / count(*), 6) AS exact_match FROM documents")
def exact_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    answer = F.when(F.expr("doc_id % 4 > 0"), F.concat(F.lit("It is K"), "doc_id", F.lit("."))).otherwise("no")
    return E.exact_match(docs.select(F.concat(F.lit(" k"), "doc_id", F.lit(". ")).alias("e"), answer.alias("a")), F.col("e"), F.col("a"))


@query("SELECT source, list_sort(list('- ' || doc_id)) AS own FROM documents GROUP BY 1")
def review_blocks(spark, sf_dir):
    """The blocks, taken apart into their lines again."""
    docs = table(spark, sf_dir, "documents")
    blocks = S.review_blocks(docs, "source", F.concat(F.lit("- "), "doc_id"))
    return blocks.select("source", F.sort_array(F.filter(F.split("block", "\n"), lambda x: x.startswith("- "))).alias("own"))


@query("SELECT event_id AS id, CASE WHEN length(raw) > 20 THEN substr(raw, 1, 20) || '…[truncated]' ELSE raw END AS raw_line FROM (SELECT event_id, ts, event_type || ' ' || props AS raw FROM events) ORDER BY ts, event_id LIMIT 100")
def trimmed_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.concat_ws(" ", "event_type", "props").alias("raw_line"), F.lit("m").alias("message"))
    return S.trimmed(rows, 100, 20).select("id", "raw_line")


@query("SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions, (SELECT list_sort(list(n_name)) FROM nation) AS names")
def json_report(spark, sf_dir):
    """The report, read again."""
    made = S.report(nations=table(spark, sf_dir, "nation"), regions=table(spark, sf_dir, "region"))
    r = F.from_json(F.get_json_object("report", "$.nations"), "array<struct<n_name:string>>")
    return made.select(F.size(r).cast("long").alias("nations"), F.json_array_length(F.get_json_object("report", "$.regions")).cast("long").alias("regions"), F.sort_array(r["n_name"]).alias("names"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END AS last_fetched FROM documents")
def touched_rows(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("last_fetched"))
    return T.touched(old, table(spark, sf_dir, "labels"), "doc_id", F.lit("2024-01-31").cast("timestamp_ntz"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def fixed_batches(spark, sf_dir):
    return S.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


# --- parsers of diagnostic texts ---


@query("SELECT n_nationkey, n_name AS name, n_nationkey::VARCHAR AS number, 'first' AS twice FROM nation")
def key_value_lines(spark, sf_dir):
    text = F.format_string('Name: %s\nnumber = "%d"\nTwice: first\ntwice: second\nno pair here\n', "n_name", "n_nationkey")
    kv = _python(Z.key_values, "map<string,string>")(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", kv.alias("kv")).select("n_nationkey", "kv.name", "kv.number", "kv.twice")


@query("SELECT s_suppkey, 'tenant' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'up' ELSE 'down' END AS status, s_name AS about FROM supplier")
def stanza_records(spark, sf_dir):
    text = F.format_string('intro\ntenants tenant tenant%d\n status old\n state status %s\n state about "%s"\nother thing\n status none\n', "s_suppkey", F.when(F.expr("s_suppkey % 2 = 0"), "up").otherwise("down"), "s_name")
    found = _python(lambda t: [{k.replace("state ", ""): v for k, v in x.items()} for x in Z.stanzas(t, r"tenants tenant (\S+)$")], "array<map<string,string>>")(text)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(found).alias("s")).select("s_suppkey", "s.name", "s.status", "s.about")


@query("SELECT n_regionkey, 'unhealthy: c' || n_nationkey AS rule, CASE WHEN n_nationkey % 2 = 0 THEN 'critical' ELSE 'warning' END AS severity, 'fan ' || n_nationkey || ' slow' AS note FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT n_regionkey, 'unhealthy: c' || n_nationkey, 'critical', 'disk full' FROM nation WHERE n_nationkey % 3 > 0")
def health_findings(spark, sf_dir):
    """Health tables with a second row under a dash for each unhealthy component."""
    bad = F.format_string("c%d unhealthy %s fan %d slow\n- unhealthy error disk full", "n_nationkey", F.when(F.expr("n_nationkey % 2 = 0"), "critical").otherwise("warning"), "n_nationkey")
    line = F.when(F.expr("n_nationkey % 3 > 0"), bad).otherwise(F.format_string("c%d ok - -", "n_nationkey"))
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    rows = texts.select("n_regionkey", F.explode(_python(Z.unhealthy, "array<struct<component:string,health:string,severity:string,description:string>>")("text")).alias("r"))
    found = V.health_findings(rows.select("n_regionkey", "r.*"))
    return found.join(rows.select("n_regionkey", F.concat(F.lit("unhealthy: "), "r.component").alias("rule")).distinct(), "rule").select("n_regionkey", "rule", "severity", "note")


@query("SELECT s_nationkey, '1.' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'up' ELSE '' END AS oper_state, s_name || ' long' AS about FROM supplier")
def cli_tables(spark, sf_dir):
    line = F.format_string("%-10s %-10s  %s long", F.concat(F.lit("1."), "s_suppkey"), F.when(F.expr("s_suppkey % 2 = 0"), "up").otherwise(""), "s_name")
    texts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("show\n\nName       Oper State  About\n---------- ----------  -----\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n\ntail\n")).alias("text"))
    return texts.select("s_nationkey", F.explode(_python(Z.table_rows, "array<map<string,string>>")("text")).alias("r")).select("s_nationkey", "r.name", "r.oper_state", "r.about")


@query("""SELECT event_id AS line_number, date_trunc('second', ts)::TIMESTAMP AS ts, 'h' || user_id AS hostname, CASE event_id % 4 WHEN 0 THEN 'err' WHEN 1 THEN 'warning' WHEN 2 THEN 'notice' ELSE 'info' END AS severity, 'svc' AS process, CASE WHEN event_id % 4 < 3 THEN event_id % 100 END::INTEGER AS pid, CASE event_id % 4 WHEN 0 THEN '0x1' WHEN 1 THEN '0x2' WHEN 2 THEN '01010028' END AS msg_code, CASE event_id % 4 WHEN 0 THEN 'told ' || event_id WHEN 1 THEN 'told ' || event_id ELSE event_type || ' done' END AS message FROM events WHERE year(ts) = 2024""")
def log_grammars(spark, sf_dir):
    """Events as lines of all four grammars by turns, in two files, read and merged by time."""
    e = table(spark, sf_dir, "events").where("year(ts) = 2024")
    iso, short = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.date_format("ts", "MMM dd HH:mm:ss")
    line = (
        F.when(F.expr("event_id % 4 = 0"), F.format_string('%s h%d svc[%d]: nodename=x priority="Error" version=1.0 msgid=0x1 msg="told %d"', iso, "user_id", F.expr("event_id % 100"), "event_id"))
        .when(F.expr("event_id % 4 = 1"), F.format_string('%s h%d svc[%d]: priority="Warn" version=1.0 msgid=0x2 msg="told %d"', short, "user_id", F.expr("event_id % 100"), "event_id"))
        .when(F.expr("event_id % 4 = 2"), F.format_string("%s h%d notice svc[%d]: 01010028:5: %s done", short, "user_id", F.expr("event_id % 100"), "event_type"))
        .otherwise(F.format_string("%s h%d info svc: %s done", iso, "user_id", "event_type"))
    )
    rows = e.select(F.concat(F.lit("f"), F.expr("event_id % 2")).alias("source_file"), F.col("event_id").alias("line_number"), line.alias("line"))
    parts = [L.parse_logs(rows.where(f"source_file = 'f{i}'"), F.lit("2024-12-31 23:59:59").cast("timestamp")) for i in (0, 1)]
    return L.merged(*parts).select("line_number", "ts", "hostname", "severity", "process", "pid", "msg_code", "message")


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'a::B x' ELSE 'HTTP::host' || event_id || ' x' END AS joined FROM events")
def command_spacing(spark, sf_dir):
    text = F.replace(case("event_id % 3", "HTTP :: host# x", "HTTP::host# x", "a::B x"), F.lit("#"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.join_commands(text).alias("joined"))


@query("SELECT 'command' AS kind, 'M' || n_nationkey || '::get' AS token FROM nation UNION SELECT 'event', 'EV_' || n_regionkey FROM nation UNION SELECT 'operator', unnest(['contains', 'equals', '==', '::']) FROM nation WHERE false UNION SELECT 'operator', 'contains' UNION SELECT 'operator', '=='")
def rulebook_tokens(spark, sf_dir):
    """Commands, events, and operators of words and symbols."""
    text = F.format_string("when EV_%d \n M%d::get contains x == y", "n_regionkey", "n_nationkey")
    return N.rulebook(table(spark, sf_dir, "nation").select(text.alias("text")))


@query("SELECT p_partkey, ['size', 'name'] AS names, ['of ' || p_size || ' units', p_name] AS texts FROM part")
def option_lines(spark, sf_dir):
    text = F.format_string("[size]\n  of %d\n  units\nname\n    %s\nplain text here\n", "p_size", "p_name")
    o = N.options(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.transform(o, lambda x: x["name"]).alias("names"), F.transform(o, lambda x: x["text"]).alias("texts"))


# --- answers of models ---


@query("SELECT item_id, CASE WHEN item_id % 4 < 3 THEN 'Q' || item_id END AS question, CASE WHEN item_id % 4 < 3 THEN 'A' END AS answer FROM benchmark")
def question_lists(spark, sf_dir):
    """Lists that are fenced, alone, in prose, and broken."""
    listed = F.format_string('[{"question": "Q%d", "answer": "A"}]', "item_id")
    text = F.when(F.expr("item_id % 4 = 0"), F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(F.expr("item_id % 4 = 1"), listed).when(F.expr("item_id % 4 = 2"), F.concat(F.lit("Here: "), listed, F.lit(" done"))).otherwise("[{broken")
    return table(spark, sf_dir, "benchmark").select("item_id", Q.question_list(text).alias("l")).select("item_id", F.get("l.question", F.lit(0)).alias("question"), F.get("l.answer", F.lit(0)).alias("answer"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN (doc_id % 10) / 10.0::DOUBLE END AS overall, CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS verdict, CASE WHEN doc_id % 4 < 2 THEN ['t'] END AS tags FROM documents")
def judge_grades(spark, sf_dir):
    """Grades with numbers as texts and a single tag; without a verdict; without JSON."""
    head = F.format_string('{"scores": {"factual": 1, "linguistic": "0.5", "domain": 0, "overall": 0.%d}', F.expr("doc_id % 10"))
    text = F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("So: "), head, F.lit(', "verdict": " PASS", "tags": "t"}'))).when(F.expr("doc_id % 4 = 1"), F.concat(head, F.lit(', "verdict": "fail", "tags": ["t"]}'))).when(F.expr("doc_id % 4 = 2"), F.concat(head, F.lit(', "verdict": "maybe"}'))).otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", Q.grade(text).alias("g")).select("doc_id", "g.scores.overall", "g.verdict", "g.tags")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10)::DOUBLE END AS score, CASE WHEN doc_id % 2 = 0 THEN 'good' END AS verdict FROM documents")
def eval_judgements(spark, sf_dir):
    text = F.when(F.expr("doc_id % 2 = 0"), F.format_string('x {"a": {}} {"score": %d, "verdict": "good"} y', F.expr("doc_id % 10"))).otherwise('{"score": 1}')
    return table(spark, sf_dir, "documents").select("doc_id", Q.judged(text).alias("j")).select("doc_id", "j.score", "j.verdict")


@query("SELECT doc_id, 'answer ' || doc_id AS plain FROM documents")
def thoughts_removed(spark, sf_dir):
    text = F.format_string("<think>hm\n%d</think>```text\nanswer %d\n```\n", "doc_id", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", X.without_thoughts(text).alias("plain"))


@query("SELECT event_id, event_id % 4 <> 1 AS valid, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END::INTEGER AS errors, CASE event_id % 4 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END::INTEGER AS warnings, CASE event_id % 4 WHEN 3 THEN [] ELSE ['http'] END AS profiles FROM events")
def code_findings(spark, sf_dir):
    code = case("event_id % 4", "when HTTP_REQUEST { HTTP::host }", "when HTTP_REQUEST { HTTP::host", "when X { HTTP::host }", "when X { regexp a }")
    f = Q.code_findings(code)
    return table(spark, sf_dir, "events").select("event_id", f["valid"].alias("valid"), F.size(f["errors"]).alias("errors"), F.size(f["warnings"]).alias("warnings"), f["profiles"].alias("profiles"))


# --- texts, titles, prompts ---


@query("SELECT doc_id, trim(substr(text, 1, 30) || ' ') AS kept FROM documents WHERE NOT contains(substr(text, 1, 30), 'License')")
def license_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.contains(F.substring("text", 1, 30), F.lit("License")))
    return docs.select("doc_id", X.cut_at_first(F.concat(F.substring("text", 1, 30), F.lit(" License X Copyright Y")), ("Copyright", "License")).alias("kept"))


@query("SELECT p_partkey, p_name || ' <x> & é' AS plain FROM part")
def tags_stripped(spark, sf_dir):
    html = F.concat(F.lit("<p>"), "p_name", F.lit("<br/> &lt;x&gt;\n &amp; <b>&#233;</b></p>"))
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_tags(html).alias("plain"))


@query("SELECT doc_id, regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', '', 'g') AS key FROM documents")
def title_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.title_key(F.substring("text", 1, 60)).alias("key"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE trim(substr(text, 1, 12), ' ') <> '' GROUP BY trim(substr(text, 1, 12), ' ')")
def first_questions(spark, sf_dir):
    return Q.first_questions(table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 12).alias("question")), "doc_id").select("doc_id")


@query("SELECT 'CVE-2024-' || (1000 + s_suppkey % 40) AS cve, coalesce(min(s_suppkey) FILTER (s_suppkey % 3 = 0), min(s_suppkey)) AS id FROM supplier GROUP BY 1")
def advisory_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.expr("s_suppkey % 3 = 0"), "kb").otherwise("x").alias("source"), F.format_string("see cve-2024-%d and CVE-1999-0001", F.expr("1000 + s_suppkey % 40")).alias("content"))
    return N.sampled_advisories(docs, "kb", 1000).select("cve", "id")


@query("SELECT p_partkey, '[' || p_name || ']' || chr(10) || substr(p_type || p_brand, 1, 8) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[t2]' || chr(10) || 'c2' AS context, '- d1: ' || substr(p_name, 1, 5) || chr(10) || '- d2: c2' AS key, CASE WHEN p_partkey % 2 = 0 THEN 'P' || chr(10) || chr(10) || 'Context:' || chr(10) || p_brand || chr(10) || chr(10) || 'Question: ' || p_name ELSE 'P' || chr(10) || chr(10) || 'Question: ' || p_name END AS prompt FROM part")
def contexts_and_prompts(spark, sf_dir):
    doc = lambda t, c: F.struct(t.alias("title"), c.alias("content"))
    key = lambda i, c: F.struct(F.lit(i).alias("doc_id"), c.alias("content"))
    three = F.array(doc(F.col("p_name"), F.concat("p_type", "p_brand")), doc(F.lit("t2"), F.lit("c2")), doc(F.lit("t3"), F.lit("c3")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", Q.context_blocks(three, 2, 8).alias("context"), P.answer_key(F.array(key("d1", F.col("p_name")), key("d2", F.lit("c2")), key("d3", F.lit("c3"))), 2, 5).alias("key"),
        P.grounded_prompt("P", F.col("p_name"), F.when(F.expr("p_partkey % 2 = 0"), F.col("p_brand")).otherwise(" ")).alias("prompt"),
    )


@query("SELECT item_id, 'Question: ' || text || chr(10) || 'Answer: a' || chr(10) || 'Reference: ' || CASE WHEN item_id % 2 = 0 THEN 'r' ELSE '(none)' END AS head FROM benchmark")
def judge_prompts(spark, sf_dir):
    made = P.judge_prompt(F.col("text"), F.lit("a"), F.when(F.expr("item_id % 2 = 0"), "r"), ("clear", "right"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.substring_index(made, "\nReply with JSON", 1).alias("head"))


@query("SELECT p_partkey, 'api:spec' || p_partkey AS doc_id, 'spec' || p_partkey || ' - ' || p_name AS title, '[\"api\",\"json\",\"spec' || p_partkey || '\"]' AS keywords FROM part")
def specification_records(spark, sf_dir):
    file = F.format_string("/a/b/spec%d.json", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", P.specification_record(file, F.col("p_name"), "api", "json").alias("r")).select("p_partkey", "r.*")


@query("SELECT vec_id, 'search_document: ' || chr(10) || substr(label::VARCHAR || '-abcdefgh', 1, 6) AS own FROM embeddings WHERE label IS NOT NULL")
def embedding_inputs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return e.select("vec_id", R.embedding_input(F.lit(None).cast("string"), F.concat(F.col("label").cast("string"), F.lit("-abcdefgh")), 6).alias("own"))


# --- retrieval ---


@query("""WITH a AS (SELECT s_suppkey AS q, 'K' || (10000 + s_suppkey) AS d, 0 AS tier FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'rfc' || s_suppkey, 1 FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s.s_suppkey, 'K' || (10000 + o.s_suppkey), 2 FROM supplier s JOIN supplier o ON o.s_suppkey % 10 = s.s_suppkey % 10 WHERE s.s_suppkey % 4 = 2 UNION ALL SELECT s.s_suppkey, 'K' || (10000 + o.s_suppkey), 3 FROM supplier s JOIN supplier o ON o.s_suppkey % 7 = s.s_suppkey % 7 WHERE s.s_suppkey % 4 = 3)
 SELECT query_id, doc_id, tier, rank FROM (SELECT q AS query_id, d AS doc_id, tier, row_number() OVER (PARTITION BY q ORDER BY tier, CASE WHEN starts_with(d, 'rfc') THEN 100000 + substr(d, 4)::INT ELSE substr(d, 2)::INT - 10000 END)::INTEGER AS rank FROM a) WHERE rank <= 3 OR tier <= 1""")
def pinned_ladder(spark, sf_dir):
    """Questions that name an article, a standard, an advisory or a command."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    one = s.select(F.col("k").alias("id"), F.concat(F.lit("K"), F.col("k") + 10000).alias("doc_id"), F.format_string("HTTP::m%s", F.translate(F.expr("cast(k % 7 as string)"), "0123456", "abcdefg")).alias("title"), F.format_string("about CVE-2024-%d here", F.expr("1000 + k % 10")).alias("content"))
    rfc = s.select((F.col("k") + 100000).alias("id"), F.concat(F.lit("rfc"), "k").alias("doc_id"), F.lit("t").alias("title"), F.lit("c").alias("content"))
    text = (
        F.when(F.expr("k % 4 = 0"), F.format_string("see k%d please", F.expr("k + 10000"))).when(F.expr("k % 4 = 1"), F.format_string("what says RFC %d", "k"))
        .when(F.expr("k % 4 = 2"), F.format_string("cve-2024-%d?", F.expr("1000 + k % 10"))).otherwise(F.format_string("how does HTTP::m%s work", F.translate(F.expr("cast(k % 7 as string)"), "0123456", "abcdefg")))
    )
    return R.pinned(s.select(F.col("k").alias("query_id"), text.alias("text")), one.union(rfc), 3)


@query("""WITH q AS (SELECT r_regionkey AS query_id, 'na' || r_regionkey AS t FROM region), d AS (SELECT n_nationkey AS doc_id, 'na' || n_regionkey || 'x' AS w, n_nationkey % 3 + 1 AS n FROM nation)
 SELECT * FROM (SELECT query_id, doc_id, round(n / (n + 1), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(n / (n + 1), 9) DESC, doc_id)::INTEGER AS rank FROM q JOIN d ON starts_with(w, t)) WHERE rank <= 3""")
def prefix_search(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.repeat(F.format_string("na%dx ", "n_regionkey"), F.expr("cast(n_nationkey % 3 + 1 as int)")).alias("text"))
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.array(F.format_string("na%d", "r_regionkey")).alias("terms"))
    return R.prefix_search(asked, docs, {"text": 1.0})
