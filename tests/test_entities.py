from pyspark.sql import functions as F

from brindle.operators import config_view as V
from brindle.operators import entities as N
from tests.test_text import CONF

INDEX = """# HTTP
## Commands
- HTTP::uri - Gets or sets
  the URI.
- HTTP::host - The host
## Events
- HTTP_REQUEST - A request came
"""
PAGE = """# HTTP::uri
## Description
Returns the URI.
## Syntax
HTTP::uri [x]
## Examples
when HTTP_REQUEST { HTTP::uri }

second
## Valid Events
HTTP_REQUEST, HTTP_RESPONSE and CLIENT_DATA
"""


def test_entities_and_questions(spark):
    index = spark.createDataFrame([("HTTP", INDEX)], "module string, text string")
    pages = spark.createDataFrame([("http://d/HTTP__uri.html", PAGE)], "url string, text string")
    order = spark.createDataFrame([("HTTP_REQUEST", 3)], "event string, place int")
    rows = N.entities(index, pages, "http://d/", order)
    got = {r.name: r for r in rows.collect()}
    assert set(got) == {"HTTP::uri", "HTTP::host", "HTTP_REQUEST"} and got["HTTP_REQUEST"].place == 3 and got["HTTP_REQUEST"].kind == "event"
    uri = got["HTTP::uri"]
    assert uri.summary == "Gets or sets the URI." and uri.description == "Returns the URI." and len(uri.examples) == 2 and uri.valid_events == ["HTTP_REQUEST", "HTTP_RESPONSE", "CLIENT_DATA"]
    qa = {(r.question, r.answer) for r in N.entity_questions(rows).collect()}
    assert ("What is the syntax of HTTP::uri?", "HTTP::uri [x]") in qa and ("What does HTTP::host do?", "The host") in qa and len(qa) == 6
    assert [r.module for r in N.modules(spark.createDataFrame([("http://d/refs/HTTP.html",), ("http://d/refs/Http.html",)], "url string")).collect()] == ["HTTP"]


def test_manuals_and_options(spark):
    lines = "intro\n\nltm pool\n\nNAME\npool - things\nSYNTAX\ncreate pool\n  x\nltm node\nNAME\nnode".split("\n")
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, i int, line string")
    got = {(r.command, r.section): r.text for r in N.command_manual(rows).collect()}
    assert got["ltm pool", "NAME"] == "pool - things" and got["ltm pool", "SYNTAX"] == "create pool\nx\nltm node" and got["ltm node", "NAME"] == "node"
    o = spark.createDataFrame([("Options\n[app-service]\n    Names the\n    service.\nname\n    The name.\n",)], "t string").select(N.options(F.col("t")).alias("o")).first().o
    assert [(x.name, x.text) for x in o] == [("app-service", "Names the service."), ("name", "The name.")]


def test_configuration_views(spark):
    texts = spark.createDataFrame([("a", CONF)], "source string, text string")
    rows = V.objects(texts)
    assert {r.partition for r in V.partitions(rows).collect()} == {"Common"}
    (app,) = V.apps(rows).collect()
    assert (app.name, app.destination, app.pool) == ("vs1", "/Common/1.2.3.4:443", "/Common/web/p1")
    d = V.app_details(rows, "/Common/vs1").first()
    assert d.monitor == "/Common/http" and "10.0.0.1" in d.pool_body and [p.path for p in d.parts] == ["/Common/http", "/Common/r1", "/Common/tcp"]
    chain = V.chain(V.pools(texts), V.virtual_servers(texts), "10.0.0.1").collect()
    assert [(c.member, c.server) for c in chain] == [("/Common/10.0.0.1:80", "/Common/vs1")]


def test_small_views(spark):
    h = spark.createDataFrame([("psu", "error", "bad"), ("fan", "warning", "slow")], "component string, severity string, description string")
    assert [r.severity for r in V.health_findings(h).collect()] == ["critical", "warning"]
    n = spark.createDataFrame([(True,), (False,)], "ready boolean")
    assert V.readiness(n).first().summary == "1/2 ready"
    a = spark.createDataFrame([("k", "", "x")], "k string, a string, b string")
    b = spark.createDataFrame([("k", "A", "B"), ("l", "C", None)], "k string, a string, b string")
    assert {tuple(r) for r in V.merged_context(a, b, "k", ["a", "b"]).collect()} == {("k", "A", "x"), ("l", "C", None)}


def test_advisories_are_taken_once(spark):
    docs = spark.createDataFrame([(1, "kb", "cve-2020-1 x"), (2, "sec", "CVE-2020-1 CVE-2020-2"), (3, "kb", "CVE-2020-3")], "id long, source string, content string")
    assert [(r.id, r.cve) for r in N.sampled_advisories(docs, "sec", 5).collect()] == [(2, "CVE-2020-1"), (3, "CVE-2020-3")]
