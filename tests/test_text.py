import pytest
from pyspark.sql import functions as F

from brindle.functions import html as H
from brindle.functions import stanzas as Z
from brindle.functions import text as X
from brindle.operators import curate as Q


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_code_tokens(spark):
    t = F.col("t")
    assert one(spark, X.commands(t), t="Use HTTP::redirect and TCP::collect, then SSL::cipher.") == ["HTTP::redirect", "SSL::cipher", "TCP::collect"]
    assert one(spark, X.commands(t), t="http::redirect") == [] and one(spark, X.commands(t), t="[X509::verify_cert_error_string]") == ["X509::verify_cert_error_string"]
    assert one(spark, X.declared_events(t), t="when CLIENT_ACCEPTED { when HTTP_REQUEST {}") == ["CLIENT_ACCEPTED", "HTTP_REQUEST"]
    assert {"contains", "and", "=="} <= set(one(spark, X.operators(t), t="if { $x contains foo and $y == $z }"))
    assert "and" not in one(spark, X.operators(t), t="android")
    assert one(spark, X.join_commands(t), t="HTTP :: uri") == "HTTP::uri"


def test_grounding(spark):
    rows = spark.createDataFrame([("Use HTTP::uri?", "yes", "HTTP::uri is"), ("Use HTTP::uri?", "TCP::x", "HTTP::uri is"), ("CLIENT_DATA?", "a", "when HTTP_REQUEST {"), ("q", "the http_request command", "when HTTP_REQUEST {"), ("q", "a", "Deprecated thing")], "question string, answer string, context string")
    assert [r.reason for r in Q.reasons(rows).collect()] == [None, "commands", "events", "mislabelled", "deprecated"]
    known = F.array(F.lit("TCP::x"))
    assert [r.reason for r in Q.reasons(rows, known).collect()][0] == "commands"


GOOD = '{"scores": {"factual": 1, "linguistic": 0.5, "domain": "0.7", "overall": 0.9}, "verdict": "PASS", "tags": "x"}'


@pytest.mark.parametrize(("text", "ok"), [(GOOD, 1), (f"```json\n{GOOD}\n```", 1), (f"```\n{GOOD}\n```", 1), (f"Sure: {GOOD} done", 1), ('{"a": "}"} then ' + GOOD, 1), ("none", 0), ("", 0), (None, 0), (GOOD.replace("0.9", '"high"'), 0), (GOOD.replace("PASS", "maybe"), 0), (GOOD.replace('"overall"', '"other"'), 0)])
def test_grades(spark, text, ok):
    row = spark.createDataFrame([(text,)], "t string").select(Q.grade(F.col("t")).alias("g")).first()["g"]
    assert bool(row) == bool(ok)
    if row:
        assert row.scores.overall == 0.9 and row.verdict == "pass" and row.tags == ["x"] and row.missing_facts == []


def test_other_answers(spark):
    assert one(spark, Q.judged(F.col("t")), t='I say {"score": 0.8, "verdict": "pass"}').score == 0.8
    got = one(spark, Q.question_list(F.col("t")), t='Here: [{"question": "a]", "answer": "b"}] end')
    assert [(g.question, g.answer) for g in got] == [("a]", "b")]


@pytest.mark.parametrize(("n", "count"), [(0, 1), (3000, 1), (3001, 2), (5400, 2), (5401, 3), (100000, 8)])
def test_char_chunks(spark, n, count):
    assert len(one(spark, X.char_chunks(F.repeat(F.lit("x"), F.col("n").cast("int"))), n=n)) == count


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1200, 1), (1201, 2), (2200, 2), (2201, 3)])
def test_sliding_chunks(spark, n, count):
    got = one(spark, X.sliding_chunks(F.repeat(F.lit("x"), F.col("n").cast("int"))), n=n)
    assert len(got) == count and (not got or got[-1].stop == n)


def test_token_chunks(spark):
    got = one(spark, X.token_chunks(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i.cast("string"))), n=0)
    assert [g.start for g in got] == [0, 448, 896] and got[0].stop == 512


def test_sanitize_and_titles(spark):
    t = F.col("t")
    assert one(spark, X.sanitize(t, ("Do not  trust this.",)), t="a\xa0 b¶\n\n do NOT\ntrust this. c \n") == "a b\nc"
    assert one(spark, X.page_title(t), t="<h1>A <b>&amp; b</b></h1>") == "A & b"
    assert one(spark, X.cut_at_first(t, ("License", "Copyright")), t="text. Copyright x License") == "text."
    assert one(spark, X.without_thoughts(t), t="<think>hm\n</think>```json\n{}\n```") == "{}"


@pytest.mark.parametrize(("link", "want"), [("b.html", "http://h.x/a/b.html"), ("/b?q#f", "http://h.x/b?q"), ("//o/c", "http://o/c"), ("https://z/1", "https://z/1"), ("?p=2", "http://h.x/a/i?p=2"), ("../d", "http://h.x/d"), ("./e", "http://h.x/a/e")])
def test_resolve(spark, link, want):
    assert one(spark, X.resolve(F.lit("http://h.x/a/i?x=1#y"), F.col("l")), l=link) == want


def test_extensions_and_types(spark):
    u = F.col("u")
    assert [one(spark, X.allowed_extension(u, (".html",)), u=x) for x in ("http://h", "http://h/a/", "http://h/A.HTML?x", "http://h/a.pdf")] == [True, True, True, False]
    assert [one(spark, X.skipped_content_type(F.nullif(u, F.lit("-"))), u=x) for x in ("-", "text/html; charset=x", "image/png")] == [False, False, True]
    assert one(spark, X.file_name(u), u="http://h/a/b/") == "a_b" and one(spark, X.file_name(u), u="http://h") == "index"


def test_html():
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav>menu</nav><main><h1>One</h1><p>Para <b>bold</b><br>next</p><ul><li>a<li>b</ul><table><tr><th>K</th><th>V</th></tr><tr><td>k1</td><td>v1</td></tr></table><h2>Two</h2><p>Do not trust</p><p>two text</p></main><script>1</script></body></html>"
    text = H.to_text(page, ("do not trust",))
    assert text.split("\n") == ["# One", "Para bold", "next", "- a", "- b", "- K: k1 | V: v1", "## Two", "two text"]
    assert H.sections(page)["Two"] == "Do not trust\ntwo text"
    assert H.links('<a href="x#1">1</a><a href="x">2</a><a href="mailto:a">3</a><a href="/y">4</a>', "http://h/p/") == ["http://h/p/x", "http://h/y"]
    assert H.heading_keywords(page) == "one two" and "\n\n" in H.to_markdown(page)
    assert H.embedded_json('<script id="D">{"a": {"subject": "s", "b": [{"body": "x"}]}}</script>', "D", ("subject", "body")) == '{"body": "x", "subject": "s"}'
    assert H.to_text("") == "" and H.to_text("<p>unclosed <li>x </div>")


CONF = """
# comment {
ltm pool /Common/web/p1 {
    members {
        /Common/10.0.0.1:80 {
            address 10.0.0.1
        }
        /Common/n2:http {
            description "a } in quotes"
        }
    }
    monitor /Common/http
}
ltm virtual /Common/vs1 {
    destination /Common/1.2.3.4:443
    pool /Common/web/p1
    profiles {
        /Common/tcp { }
        /Common/http { }
    }
    rules {
        /Common/r1
    }
}
ltm rule /Common/r1 {
when HTTP_REQUEST { if { [HTTP::uri] eq "{" } { pool p } }
}
"""


def test_configuration():
    found = {o["path"]: o for o in Z.objects(CONF)}
    assert list(found) == ["/Common/web/p1", "/Common/vs1", "/Common/r1"] and found["/Common/web/p1"]["folder"] == "web" and found["/Common/r1"]["attributes"] == {} and "HTTP::uri" in found["/Common/r1"]["body"]
    (pool,) = Z.pools(CONF)
    assert [(m["address"], m["port"]) for m in pool["members"]] == [("10.0.0.1", 80), ("n2", 0)] and pool["monitor"] == "/Common/http"
    (vs,) = Z.virtual_servers(CONF)
    assert (vs["address"], vs["port"], vs["pool"], vs["profiles"], vs["rules"]) == ("1.2.3.4", 443, "/Common/web/p1", ["/Common/tcp", "/Common/http"], ["/Common/r1"])


def test_outputs():
    assert Z.key_values("Version: 1.2\nBuild = 3\nversion: 9") == {"version": "1.2", "build": "3"}
    assert Z.stanzas("tenants tenant a\n state running-state deployed\n type X\nother\n lost 1\ntenants tenant b\n", r"tenants tenant (\S+)") == [{"name": "a", "state running-state": "deployed", "type": "X"}, {"name": "b"}]
    text = "COMPONENT x\npsu-1 - unhealthy error PSU Status Output ok - -\n- - unhealthy critical Fan slow\nfine ok - -"
    assert [(u["component"], u["severity"], u["description"]) for u in Z.unhealthy(text)] == [("psu-1", "error", "PSU Status Output"), ("psu-1", "critical", "Fan slow")]
    a = Z.snapshot_path("shared/tmstat/snapshots/blade0/performance/60/160")
    assert (a["family"], a["blade"], a["type"], a["interval"], a["root"]) == ("snapshot", "blade0", "performance", "60", "shared")
    b = Z.snapshot_path("/var/tmstat/cluster/blade1-public")
    assert (b["family"], b["scope"], b["blade"], b["type"]) == ("segment", "cluster", "blade1", "public")
    assert Z.snapshot_path("var/log/x") is None and Z.snapshot_path("var/tmstat") is None


def test_code_findings(spark):
    got = one(spark, Q.code_findings(F.col("t")), t="when CLIENT_ACCEPTED { HTTP::uri; regexp x ")
    assert not got.valid and len(got.errors) == 1 and len(got.warnings) == 3 and got.profiles == ["http"]


def test_permutations():
    assert sorted(Q.permutation("a", 4)) == [0, 1, 2, 3] and Q.permutation("a", 4) == Q.permutation("a", 4)
    assert len({tuple(Q.permutation(str(i), 3)) for i in range(50)}) == 6
