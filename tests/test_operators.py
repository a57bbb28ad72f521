import io
import tarfile

import pytest
from pyspark.sql import functions as F

from brindle.operators import collapse as C
from brindle.operators import curate as Q
from brindle.operators import evaluate as E
from brindle.operators import retrieval as R
from brindle.operators import tables as T
from brindle.sources import archives as A
from brindle.sources import documents as D
from brindle.sources import sinks as K


def now():
    return F.lit("2024-02-01").cast("timestamp_ntz")


def ranks(spark, *lists):
    return [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(x)], "query_id int, doc_id string, rank int") for x in lists]


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    assert order(R.rrf(ranks(spark, "abc", "acb")))[0] == "a"
    assert order(R.rrf(ranks(spark, ["x", "shared"], ["shared", "y"])))[0] == "shared"
    assert order(R.rrf(ranks(spark, "abc", "")))[:3] == ["a", "b", "c"]
    for w, first in (([1, 0.5], "bm"), ([0.5, 1], "dn")):
        assert order(R.rrf(ranks(spark, ["bm"], ["dn"]), w))[0] == first
    a, b = ranks(spark, "abc", "xcy")
    assert order(R.fuse(a, b)) == ["a", "b", "c", "x", "y"] and order(R.fuse(a, b, "overlap"))[0] == "c"


def test_dense(spark):
    v = spark.createDataFrame([("d1", [0.0, 1.0, 0.0]), ("d1", [1.0, 0.0, 0.0]), ("d2", [0.8, 0.6, 0.0]), ("d3", [0.0, 0.0, 0.0])], "doc_id string, v array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0])], "query_id int, q array<float>")
    assert order(R.dense(q, v, 2)) == ["d1", "d2"]


DOCS = [
    (1, "K14190", "K14190: Overview of things", "", "hotfix text"), (2, "rfc8267", "NFS", "", "about rfc"), (3, "K000130024", "Advisory", "", "see CVE-2022-3996 now"), (4, "ref", "HTTP::redirect", "", "command page"),
    (5, "K4918", "K4918: hotfix policy", "", "hotfix policy details"), (6, "K4918b", "K4918: hotfix policy", "", "hotfix policy"), (7, "ID123456", "snat bug", "", "snat pool frobnicated"), (8, "kb", "snat pool", "snat", "snat pool how to"),
]


def test_ladder_and_hybrid(spark):
    docs = spark.createDataFrame(DOCS, "id long, doc_id string, title string, keywords string, content string")
    ask = lambda text: order(R.hybrid(spark.createDataFrame([(1, text)], "query_id int, text string"), docs, None, 5))
    assert ask("Tell me about K14190")[0] == "K14190"
    assert "rfc8267" in ask("What is in RFC 8267?") and "K000130024" in ask("CVE-2022-3996") and ask("HTTP::redirect")[0] == "ref"
    assert ask("hotfix policy").count("K4918") + ask("hotfix policy").count("K4918b") == 1
    assert "ID123456" in ask("snat frobnicated nowhere")


def test_classes(spark):
    rows = spark.createDataFrame([("the HTTP::uri command",), ("status code 404",), ("hello",), ("valid 1234 debug",), ("ID 12345",), ("a defect",)], "t string")
    got = rows.select(R.classify(F.col("t"), ["pool"], ["status code"]).alias("m"), R.bug_intent(F.col("t")).alias("b")).collect()
    assert [r.m for r in got][:3] == ["vendor", "standard", "general"] and [r.b for r in got][3:] == [False, True, True]
    src = rows.select(R.sources_for(F.lit("a bug"), F.lit("vendor"), {"vendor": ["a"], "general": None}, "bugs").alias("s")).first()["s"]
    assert src == ["a", "bugs"]


def test_metrics(spark):
    r = ranks(spark, "abcdefg")[0]
    gold = spark.createDataFrame([(1, "f"), (1, "g"), (2, "a")], "query_id int, doc_id string")
    got = {x.query_id: x for x in E.retrieval_metrics(r, gold).collect()}
    assert (got[1].first_rank, got[1].hit5, got[1].hit10) == (6, 0.0, 1.0) and abs(got[1].rr - 1 / 6) < 1e-12 and got[2].rr == 0


def test_leaderboard(spark):
    judged = spark.createDataFrame([("p1", "rag", "A", {"A": 3, "B": 1}), ("p2", "rag", "B", {"A": 2, "B": 4})], "packet_id string, condition string, best string, scores map<string,int>")
    mapping = spark.createDataFrame([("p1", "A", "m"), ("p1", "B", "n"), ("p2", "A", "n"), ("p2", "B", "m")], "packet_id string, letter string, model string")
    rows = {r.model: r for r in E.leaderboard(E.deanonymised(judged, mapping), ["score"]).collect()}
    assert rows["m"].score == 3.5 and rows["m"].wins == 2 and rows["n"].wins == 0
    answers = spark.createDataFrame([(1, "rag", "m", "x"), (1, "rag", "n", "y"), (2, "rag", "m", "z")], "qid int, condition string, model string, answer string")
    assert [(r.A, r.B) for r in E.packets(spark.createDataFrame([(1, "q"), (2, "r")], "qid int, question string"), answers, {"A": "n", "B": "m"}).collect()] == [("y", "x")]


def test_collapse(spark):
    rows = spark.createDataFrame([("b", "1", "x", 0), ("a", "2", "y", 1), ("b", "bad", "z", 2), (None, "9", "w", 3)], "name string, c string, o string, pos int")
    assert [(r.name, r.c, r.o) for r in C.collapse(rows, "name", ["c"], ["o"], "pos").collect()] == [("b", 1, "x"), ("a", 2, "y")]
    certs = spark.createDataFrame([("a.crt", "5", 0), ("b.crt.12", "1", 1), ("c", "x", 2)], "name string, e string, pos int")
    assert [r.name for r in C.soonest(C.not_bundled(certs, "name"), "e", 5, "pos").collect()] == ["a.crt", "c"]


def test_upserts(spark):
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    old = spark.createDataFrame([("a", "h1", "A"), ("b", "h2", "B")], "doc_id string, hash string, text string").withColumn("created_at", t).withColumn("last_fetched", t)
    new = spark.createDataFrame([("a", "h1", "A!", 0), ("b", "h3", "B0", 1), ("b", "h4", "B1", 2), ("c", "h5", "C", 3)], "doc_id string, hash string, text string, _pos int")
    got = {r.doc_id: r for r in T.upsert(old, new, "doc_id", now(), "hash").collect()}
    assert {k: (v.text, v.outcome) for k, v in got.items()} == {"a": ("A", "unchanged"), "b": ("B1", "updated"), "c": ("C", "inserted")}
    assert got["b"].created_at.month == 1 and got["b"].last_fetched.month == 2
    by_url = T.upsert_by_url(spark.createDataFrame([("u", "d")], "url string, doc_id string"), spark.createDataFrame([("u", "x"), ("v", "d"), ("w", "e")], "url string, doc_id string"))
    assert {r.url: r.outcome for r in by_url.collect()} == {"u": "updated", "v": "error", "w": "inserted"}


def test_crawl_and_time_to_live(spark):
    pages = spark.createDataFrame([("a", ["b", "c"]), ("b", ["a", "d"]), ("d", ["e"])], "url string, links array<string>")
    assert {(r.url, r.depth) for r in T.crawl(pages, spark.createDataFrame([("a",)], "url string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    log = spark.createDataFrame([("a", 0.0), ("a", 86400.0 * 9), ("b", 86400.0 * 3)], "url string, fetched_ts double")
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    now = F.lit("1970-01-11").cast("timestamp")
    assert {r.url for r in T.to_fetch(urls, log, now, 7).collect()} == {"b", "c"} and T.to_fetch(urls, log, now, 7, force=True).count() == 3


def test_splits_and_quotas(spark):
    rows = spark.range(100).withColumnRenamed("id", "pos").withColumn("tag", F.col("pos") % 4)
    exact = Q.split_exact(rows, "pos", 0.9)
    assert exact.where("part = 'train'").count() == 90 and sorted(map(str, exact.collect())) == sorted(map(str, Q.split_exact(rows.repartition(5), "pos", 0.9).collect()))
    assert Q.seeded_sample(rows, F.col("pos"), 3, ["tag"]).count() == 12
    assert [r.tag for r in Q.quotas(rows, "tag", "pos", 2, 6).collect()] == [0, 1, 2, 3, 0, 1]
    q = spark.createDataFrame([("q1 ", 1), ("q1", 0), ("", 2)], "question string, pos int")
    assert [r.pos for r in Q.first_questions(q, "pos").collect()] == [0]
    assert Q.package_summary(q, "pos").first().n == 3


def archive(files, bad=False):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        if bad:
            tar.addfile(tarfile.TarInfo("../../etc/passwd"), io.BytesIO(b""))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(archive({"var/log/ltm": b"two\xff", "var/log/ltm.1": b"x", "config/main.conf": b"ltm {}", "other/var/log/ltm": b"more"}))
    rows = A.read_archives(spark, str(tmp_path / "a.tar.gz"))
    assert {(r.member, r.k) for r in rows.select("member", A.kind(F.col("member")).alias("k")).collect()} == {("var/log/ltm", "log"), ("var/log/ltm.1", "log"), ("config/main.conf", "config"), ("other/var/log/ltm", "log")}
    joined = {r.source_file: r.content for r in A.joined_logs(A.texts(rows)).collect()}
    assert joined["ltm"] == "two�\nmore"
    with pytest.raises(A.UnsafeArchive):
        list(A.members(archive({"a": b""}, bad=True), strict=True))
    assert [m[0] for m in A.members(archive({"a": b"1"}, bad=True))] == ["a"]


def test_nested_archives():
    data = archive({"bundle/manifest.json": b"{}", "bundle/subpackages/m/filesystem/var/log/x.log": b"l", "bundle/subpackages/k8s_1/filesystem/var/log/x.log": b"l", "bundle/subpackages/m/filesystem/var/log/journal/b": b"l"})
    assert A.is_nested(data) and [m[0] for m in A.members(data, A.wanted_nested)] == ["bundle/manifest.json", "bundle/subpackages/m/filesystem/var/log/x.log"]
    manifests = {"bundle/manifest.json": {"packages": [{"name": "n", "path": "x/peer-1"}, {"path": "system-manager"}, {"path": "k8s_z"}], "commands": []}, "bundle/subpackages/system-manager/manifest.json": {"commands": [{"name": "show version", "output": "commands/1/out"}, {"name": "nothing"}]}, "bundle/subpackages/peer-1/manifest.json": {"commands": [{"name": "Show  Version | x", "output": "c"}, {"name": "show b", "output": "b"}]}}
    assert A.subpackage_prefixes(manifests) == ["bundle/subpackages/peer-1/", "bundle/subpackages/system-manager/"]
    files = {"bundle/subpackages/system-manager/commands/1/out": "v1", "bundle/subpackages/peer-1/c": "v2", "bundle/subpackages/peer-1/b": " "}
    assert A.command_outputs(files, manifests) == {"show version": "v1"}


def test_documents(spark, tmp_path):
    (tmp_path / "K1.md").write_text("# K1: A title\nsee https://kb.example.com/K1 and cve-2020-1 " + "x" * 60)
    (tmp_path / "K2.md").write_text("short")
    texts = D.whole_texts(spark, str(tmp_path))
    (r,) = D.articles(texts, ["kb.example.com"]).collect()
    assert (r.doc_id, r.title, r.url, r.keywords) == ("K1", "A title", "https://kb.example.com/K1", ["CVE-2020-1"])
    assert {(c.heading, c.chunk_no) for c in D.heading_chunks(texts).collect()} == {("K1: A title", 1), (None, 1)}
    (tmp_path / "i.xml").write_text("<i><rfc-entry><doc-id>RFC0042</doc-id><title>T</title><author><name>N</name></author><keywords><kw>a</kw><kw>b</kw></keywords><obsoletes><doc-id>RFC1</doc-id></obsoletes></rfc-entry></i>")
    (x,) = D.rfc_index(spark, str(tmp_path / "i.xml")).collect()
    assert (x.doc_id, x.number, x.authors, x.keywords, x.obsoletes) == ("rfc0042", "42", ["N"], ["a", "b"], ["rfc1"])
    (tmp_path / "o.xml").write_text("<s><object><name>v</name><n>3</n></object><object><name>w</name></object></s>")
    assert [o.fields for o in D.xml_objects(spark, str(tmp_path / "o.xml"), "object", ["name", "n"]).collect()] == [{"name": "v", "n": "3"}, {"name": "w"}]
    spec = '{"info": {"title": "T", "description": "About. Licensed under x"}, "paths": {"/a": {"get": {"summary": "list  it"}, "put": {"summary": "list it"}}}, "definitions": {"D": {"properties": {"p": {"description": "a p"}}}}}'
    s = D.api_specs(spark.createDataFrame([("f", spec)], "file string, text string"), ("Licensed under",)).first()
    assert s.endpoints == ["list it"] and s.content == "About.\n\nlist it\n\na p"
    (tmp_path / "v.bin").write_bytes(b"\x00\x00\x80\x3f" * 4)
    assert [(v.doc_id, v.chunk_idx, v.v) for v in D.vectors(spark, str(tmp_path / "v.bin"), ["a", "a"], 2).collect()] == [("a", 0, [1.0, 1.0]), ("a", 1, [1.0, 1.0])]
    with pytest.raises(ValueError):
        D.vectors(spark, str(tmp_path / "v.bin"), ["a"], 2)


def test_bug_pages(spark):
    html = "<title>Bug 1</title><b>Severity:</b> 2-Critical<h2>Symptoms</h2><p>see k12345</p><h2>Impact</h2>none" + " " * 1000
    pages = spark.createDataFrame([("1", html), ("2", "short")], "bug_id string, html string").withColumn("mtime", F.lit("2024-05-06").cast("timestamp"))
    log = spark.createDataFrame([("1", "2020-01-01T0", 1), ("1", "2021-01-01T0", 2)], "bug_id string, ts string, line int")
    (r,) = D.bug_pages(pages, log).collect()
    assert (r.severity, r.refs, r.fetched, r.sections) == ("2-Critical", ["K12345"], "2021-01-01", {"Symptoms": "see k12345", "Impact": "none"})
    (c,) = D.bug_pages(pages, log).select(D.bug_content(F.col("bug_id"), F.col("severity"), F.col("sections"), F.col("refs")).alias("c")).collect()
    assert c.c.split("\n\n")[0] == "Bug 1 | Severity: 2-Critical"


def test_robots_and_keywords(spark):
    rules, delay = D.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n\nUser-agent: Other\nDisallow: /")
    assert delay == 2 and [D.robots_allow(rules, p) for p in ("/a/x", "/a/b/c", "/z")] == [False, True, True]
    assert D.robots_rules("User-agent: Other\nDisallow: /", "other bot")[0] == [("/", False)]
    got = spark.createDataFrame([('["a", "b"]',), ("a b",), (None,)], "k string").select(D.keywords(F.col("k")).alias("k")).collect()
    assert [r.k for r in got] == [["a", "b"], ["a", "b"], []]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q", None), ("r", "commands")], "question string, reason string")
    K.write_failures(rows, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).count() == 1 and spark.read.json(str(tmp_path / "good")).columns == ["question"]
    with pytest.raises(Exception, match="exists"):
        K.write_json_lines(rows, str(tmp_path / "bad"), "fail")
    entries = spark.createDataFrame([(1, "2024-01-01", "m", "x" * 3000)], "id long, ts string, message string, raw_line string")
    assert len(K.trimmed(entries).first().raw_line) < 2100
    import json

    text = K.report(rows=rows, n=rows.agg(F.count("*").alias("n"))).first().report
    assert json.loads(text)["n"] == [{"n": 2}] and len(json.loads(text)["rows"]) == 2
    K.package(str(tmp_path / "p.zip"), {"a": b"1"}, {"n": 1})
    assert (tmp_path / "p.zip").stat().st_size > 0
