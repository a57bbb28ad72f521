"""Queries on keys that the small tables don't have."""

import random
import re

import duckdb

from brindle.functions import html as H
from brindle.plans import QUERIES, SQL


def test_standards_index_with_numbers_of_five_digits(spark, tmp_path):
    keys = [1, 9999, 10000, 10001, 123456]
    spark.createDataFrame([(k, f"s{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(map(str, r)) for r in QUERIES["standards_index"](spark, str(tmp_path)).select("doc_id", "number", "title").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT doc_id, number, title FROM ({SQL['standards_index']})").fetchall())
    assert {number for _, number, _ in got} == {str(k) for k in keys}


def test_page_parts_reads_each_page_once_in_several_tasks(spark, tmp_path):
    spark.range(1, 40_001).selectExpr("id AS p_partkey", "'n' || id AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = QUERIES["page_parts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1 and len(re.findall(r"pythonUDF\d+#\d+", plan.split("ArrowEvalPython [")[1].split("]")[0])) <= 1
    assert "hashpartitioning(p_partkey" in plan  # a file of one row group isn't one task's


def test_parts_are_those_of_the_single_functions():
    pages = ["<h1>A</h1><p>b<ul><li>c</ul><a href='x?a=1&amp;b'>d</a><meta name=keywords content=k>", "<!doctype html><title>x & y</title><article><nav>n</nav><h2>B</h2><p>t &lt;</p><a href=\"/z#f\">l</a></article>", "", "a < b", "<script>if (a<b) {}</script><h3>C</h3><p>x<!-- c --></p>"]
    for page in pages:
        assert H.parts(page, "http://h/") == (H.heading_keywords(page), H.links(page, "http://h/"), H.preferred_area(page), H.sections(page))


def test_plain_markup_gives_the_parsers_tree():
    def shown(n):
        return n.tag, sorted(n.attrs.items()), [c if isinstance(c, str) else shown(c) for c in n.children]

    rnd, plain = random.Random(4), 0
    bits = ["<p>", "</p>", "<LI>", "<br/>", '<a href="x&amp;y&copy=2">', "</a>", " a &lt; b &amp c", "&", "<", ">", "<!-- c -->", "<!-->", "<!doctype html>", "<script>", "</script>", "<title>", "</title>", "<textarea>", "</textarea>", "<td>", "<tr>", "<b x=1>", "<svg>", "\n", "<a B='1' b=\"2\" c>", "</>", "<?p>"]
    for _ in range(5000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 6)))
        if (made := H._plain_tree(page)) is not None:
            plain += 1
            parser = H._Tree()
            parser.feed(page)
            parser.close()
            assert shown(made) == shown(parser.root), page
    assert plain > 500
