"""Deep pages, pages' tables and notes, equal headings, cycles, entities, batches, sitemaps and tables of contents."""

import gzip

from pyspark.sql import functions as F

from brindle.functions import html as H
from brindle.functions import stanzas as Z
from brindle.functions import text as X
from brindle.operators import retrieval as R
from brindle.operators import rules
from brindle.operators import tables as T
from brindle.sources import archives as A
from brindle.sources import documents as D
from brindle.sources import sinks as S


def test_deep_html():
    page = "<div>" * 3000 + "<h2>T</h2><p>text</p>" + "</div>" * 3000
    assert H.to_text(page) == "## T\ntext" and H.reading_text(page) == "## T\ntext" and H.tree(page).text() == "T text"


def test_content_tables_and_notes():
    page = (
        "<body><main><p>no</p></main><article><h1>One</h1><div class='admonition'>old wiki</div><div class='line-block'> </div>"
        "<table><tr><th>K:</th><td>V</td></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td></tr><tr><td></td><td>2</td></tr></table>"
        "<ul><li><p>x</p></li></ul><pre>p <code>c</code></pre></article></body>"
    )
    assert H.reading_text(page, notes=("old wiki",)).split("\n") == ["# One", "- K: a | V: 1", "- b", "- V: 2", "- x", "x", "p c", "c"]
    assert H.reading_text("<div>plain <b>words</b></div>") == "plain\nwords" and H.reading_text("") == ""
    found = H.syntax_sections("<h1>pool</h1><p>Module: ltm</p><p>Syntax: create pool</p><div>Makes pools.</div><pre>example: x</pre><h1>more</h1>")
    assert found["name"] == "pool" and found["syntax"] == "Syntax: create pool" and found["description"] == "Makes pools.\nmore" and found["examples"] == ["example: x"]
    assert H.syntax_sections("<p>text</p>") is None


def test_equal_headings_and_later_files(spark):
    pages = spark.createDataFrame([("1", "<title>t</title><h2>A</h2>one<h2>A</h2>two<h3>B</h3>three" + " " * 1000, None)], "bug_id string, html string, mtime timestamp")
    (r,) = D.bug_pages(pages, spark.createDataFrame([], "bug_id string, ts string, line int")).collect()
    assert r.sections == {"A": "one\ntwo", "B": "three"}
    docs = spark.createDataFrame([("u", "1", "a.json"), ("u", "2", "b.json")], "url string, doc_id string, file string")
    assert D.by_url(docs).first().doc_id == "2"


def test_reach_on_cycles(spark):
    n = spark.range(25).select(F.col("id").alias("a"), ((F.col("id") * 3 + 1) % 25).alias("b"))
    edges = n.union(n.select("a", ((F.col("a") * 7 + 2) % 25).alias("b")))
    assert T.reach(edges, spark.createDataFrame([(24,)], "node long")).count() == 25


def test_entities(spark):
    df = spark.createDataFrame([("&#65;&eacute;&amp;lt;&unknown; & &#x20AC; &lt;b&gt; &#0; &#xD800;",), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(X.unescape(F.col("t"))).collect()] == ["Aé&lt;&unknown; & € <b> &#0; &#xD800;", None, "none"]


def test_batches_do_not_depend_on_partitions(spark):
    a, b = ({(r.i, r.batch) for r in S.batches(spark.range(1005).withColumnRenamed("id", "i").repartition(n), "i", 100).collect()} for n in (1, 7))
    assert a == b == {(i, i // 100) for i in range(1005)}


def test_many_queries_without_a_cross_join(spark):
    asked = spark.range(1500).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id") / 100), F.sin(F.col("id") / 100)).alias("q"))
    vectors = spark.range(40).select(F.concat(F.lit("d"), F.col("id")).alias("doc_id"), F.array(F.cos(F.col("id") / 6), F.sin(F.col("id") / 6)).alias("v"))
    found = R.dense(asked, vectors, 2)
    assert found.count() == 3000 and found.select("query_id").distinct().count() == 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sitemaps_and_contents(spark):
    xml = b"<urlset><loc> http://h/a?x=1&amp;y=2 </loc><loc>http://h/t5</loc><loc>http://h/t5</loc></urlset>"
    files = spark.createDataFrame([("a.xml", bytearray(xml)), ("b.xml.gz", bytearray(gzip.compress(xml.replace(b"t5", b"t6"))))], "path string, content binary")
    assert {r.url for r in D.sitemaps(files).collect()} == {"http://h/a?x=1&y=2", "http://h/t5", "http://h/t6"}
    assert {r.url for r in D.sitemaps(files, r"/t\d+$").collect()} == {"http://h/t5", "http://h/t6"}
    toc = '<a href="a.html#x">A &amp; b</a><a href="#y">no</a><a href="a.html">again</a><a class="c" href="b.html"><b>B</b></a><a href="c.html"> </a>'
    (r,) = spark.createDataFrame([(toc,)], "h string").select(D.contents(F.col("h")).alias("c")).collect()
    assert [tuple(x) for x in r.c] == [("a.html", "A & b"), ("b.html", "B")]


def test_tables_of_a_command_line():
    text = "show x\n\nName      Oper State  Speed\n--------  ----------  -----\n1.1       up          10G\n1.2                   100G more\n\nother\n"
    assert Z.table_rows(text) == [{"name": "1.1", "oper_state": "up", "speed": "10G"}, {"name": "1.2", "oper_state": "", "speed": "100G more"}]


def test_member_rules_are_the_callers():
    rules = A.Nested(root="top", inside=("/filesystem/var/own/",), ends=(), pairs=(), dropped=())
    assert [A.wanted_nested(n, rules) for n in ("top/manifest.json", "x/manifest.json", "top/subpackages/a/filesystem/var/own/f", "top/subpackages/a/filesystem/var/log/f")] == [True, False, True, False]


def test_pairs_over_all_rows(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", f"h{i % 3}", "link down" if i % 2 == 0 else "link up") for i in range(12)]
    logs = spark.createDataFrame(rows, "id long, ts string, host string, message string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rule = {"name": "flap", "patterns": [{"regex": "down"}, {"regex": "up"}], "correlation": {"max_window_minutes": 2}}
    assert rules.paired_finding(logs, rule, []).first().hits == 6
    assert rules.paired_finding(logs, rule, ["host"]).count() == 0  # three minutes apart on each host
