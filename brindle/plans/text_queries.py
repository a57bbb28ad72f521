"""Text, chunk, page and log-parsing queries over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import html as H
from brindle.functions import logs as L
from brindle.functions import text as X
from brindle.plans.registry import query, table


@query("SELECT substr(replace(lower(text), ' ', ''), 1, 40) AS key, min(doc_id) AS first_doc_id, count(*) AS n FROM documents GROUP BY 1")
def near_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(X.dedupe_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def exact_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"))


@query("SELECT doc_id, list_aggregate(list_distinct(list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')), 'count') AS n FROM documents")
def distinct_ordered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.distinct_ordered(F.split("text", r"\."))).cast("long").alias("n"))


@query("SELECT doc_id, i::INTEGER AS i, substr(text, i * 2700 + 1, 3000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 3000 THEN 1 ELSE least(8, ceil(length(text) / 2700)::BIGINT) END)) AS i FROM documents)")
def char_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(X.char_chunks(F.col("text"))))


@query("SELECT doc_id, (i * 1000)::INTEGER AS start, least(i * 1000 + 1200, length(text))::INTEGER AS stop, substr(text, i * 1000 + 1, 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1200 THEN 1 ELSE ceil((length(text) - 200) / 1000)::BIGINT END)) AS i FROM documents)")
def sliding_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(X.sliding_chunks(F.col("text"))))


@query("SELECT doc_id, start::INTEGER AS start, (start + 512)::INTEGER AS stop, chunk FROM (SELECT doc_id, start, trim(array_to_string(w[start + 1:start + 512], ' ')) AS chunk FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 448)) AS start FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))) WHERE length(chunk) >= 120")
def token_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(X.token_chunks(F.split("text", " "))))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS clean FROM documents")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.sanitize(F.col("text"))).alias("clean"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean FROM documents WHERE length(text) >= 200")
def ws_collapse_min_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") >= 200).select("doc_id", F.md5(X.collapse_spaces(F.col("text"))).alias("clean"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]+')))) AS capitals FROM documents")
def capital_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9_]+)\b"), F.lit(1)))).alias("capitals"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' & b' WHEN 2 THEN '' ELSE p_brand END AS title FROM part")
def page_title(spark, sf_dir):
    """Pages with a title, with an empty one and a heading, with neither, and with both."""
    html = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('<title>\n ', p_name, ' </title>x') WHEN 1 THEN concat('<title> </title><H1 class=x>', p_type, ' <i>&amp;</i> b</H1>') WHEN 2 THEN '<p>none</p>' ELSE concat('<h1>h</h1><TITLE>', p_brand, '</TITLE>') END""")
    return table(spark, sf_dir, "part").select("p_partkey", X.page_title(html).alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.hrefs(F.col("html"))).alias("link"))


@query("""SELECT page_id, url, list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1), lambda x: starts_with(x, '/') AND NOT starts_with(x, '//')), lambda x: regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(x, '#.*$', '')) ).list_sort() AS links FROM pages""")
def link_domain_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    own = F.filter(F.transform(F.filter(X.hrefs(F.col("html")), lambda x: x.startswith("/") & ~x.startswith("//")), lambda x: X.resolve(F.col("url"), x)), lambda x: X.host(x) == X.host(F.col("url")))
    return pages.select("page_id", "url", F.array_sort(F.array_distinct(own)).alias("links"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, substr(coalesce(nullif(replace(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/', '_'), ''), 'index'), 1, 200) AS file FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.host(u).alias("host"), X.path(u).alias("path"), X.file_name(u).alias("file"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(^|/|1|3|\\.html)$')")
def ext_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(X.allowed_extension(F.col("url"), (".html", "1", "3"))).select("page_id", "url")


@query()
def html_to_text(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.html_text(h).alias("text"), H.html_sections(h).alias("sections"), H.html_links(h, F.col("url")).alias("links"), H.html_keywords(h).alias("keywords"))


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_markdown(F.col("html")).alias("markdown"), H.html_area(F.col("html")).alias("area"))


_LINES = "SELECT user_id, event_id, ts, event_type, value FROM events"


@query("SELECT 'u' || user_id AS source_file, date_trunc('second', ts)::TIMESTAMP AS ts, 'web' || (user_id % 3) AS hostname, CASE WHEN event_type = 'error' THEN 'err' ELSE 'info' END AS severity, CASE WHEN event_type = 'error' THEN 3 ELSE 6 END AS severity_num, 'svc' AS process, event_id::INTEGER AS pid, '01010028' AS msg_code, event_type || ' happened' || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'because ' || event_id ELSE '' END AS message FROM events WHERE year(ts) = 2024")
def log_parse_fold(spark, sf_dir):
    """Events written as log lines (with indented lines after every second one, and junk) and parsed again."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "err").otherwise("info")
    head = F.format_string("%s web%d %s svc[%d]: 01010028:3: %s happened", F.date_format("ts", "MMM dd HH:mm:ss"), F.col("user_id") % 3, level, F.col("event_id"), F.col("event_type"))
    more = F.when(F.col("event_id") % 2 == 0, F.array(head, F.lit("junk that no grammar knows"), F.format_string("\t because %d", "event_id"))).otherwise(F.array(head, F.lit("   ")))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    lines = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_file"), at.alias("at"), F.posexplode(more).alias("i", "line")).select("source_file", (F.col("at") * 10 + F.col("i")).alias("line_number"), "line")
    return L.parse_logs(lines, F.lit("2024-12-31 23:59:59").cast("timestamp")).select("source_file", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "hostname", "severity", "severity_num", "process", "pid", "msg_code", "message")


@query("SELECT event_id::VARCHAR AS msg_code, ts, CASE event_type WHEN 'error' THEN 'err' WHEN 'view' THEN 'warning' ELSE 'notice' END AS severity, props AS message FROM (SELECT * REPLACE (replace(props, '\"', '''') AS props) FROM events)")
def event_log_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' ELSE 'NA' END")
    line = F.format_string('%d svc EVENT x %s "%s" "%s UTC"', "event_id", kind, F.replace("props", F.lit('"'), F.lit("'")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return L.parse_events(e.select(F.lit("f").alias("source_file"), F.col("event_id").alias("line_number"), line.alias("line"))).select("msg_code", "ts", "severity", "message")
