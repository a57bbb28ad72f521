import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.functions import logs as L
from brindle.operators import rules as R
from brindle.operators import search as S


def now():
    return F.lit("2026-06-15 12:00:00").cast("timestamp")
LOG = """Jun  1 10:00:00 test-host notice mcpd[1234]: 01070638:5: Pool member /Common/a:80 monitor status down. [ /Common/http: down ]
Jun  1 10:00:10 test-host err mcpd[1234]: 01010028:3: No members available for pool /Common/test_pool
Jun  1 10:05:00 test-host notice mcpd[1234]: 01070727:5: Pool member /Common/a:80 monitor status up.
Jun  1 10:06:00 test-host err tmm[99]: 01010028:3: No members available for -pool* (member: x)"""


def parsed(spark, text, cap=L.CONTINUATION_CAP):
    files = spark.createDataFrame([("f", text)], "source_file string, content string")
    return L.parse_logs(L.lines(files), now(), cap).orderBy("line_number").collect()


def test_iso_structured(spark):
    (r,) = parsed(spark, '2026-01-16T00:57:13.773098+00:00 mseg lopd[22]: nodename=blade-1(p1) priority="Info" version=1.0 msgid=0x6201000000000022 msg="LOP daemon LOPD starting"')
    assert (r.process, r.pid, r.hostname, r.severity, r.msg_code, r.message) == ("lopd", 22, "mseg", "info", "0x6201000000000022", "LOP daemon LOPD starting")
    assert r.ts == dt.datetime(2026, 1, 16, 0, 57, 13, 773098)


def test_each_grammar(spark):
    rows = parsed(spark, 'May  8 13:08:07 lopd lopd[22]: priority="Notice" version=1.0 msgid=0x62 msg="up"\n2024-03-26T19:37:03.5+02:00 h warning app: hello\n' + LOG)
    assert [r.severity for r in rows] == ["notice", "warning", "notice", "err", "notice", "err"]
    assert rows[1].ts == dt.datetime(2024, 3, 26, 17, 37, 3, 500000)
    assert (rows[3].msg_code, rows[3].own_severity, rows[3].process, rows[3].pid) == ("01010028", 3, "mcpd", 1234)


def test_years_and_bad_days(spark):
    rows = parsed(spark, "Jul  1 10:00:00 h err p: later\nJun 14 10:00:00 h err p: before\nFeb 30 10:00:00 h err p: never")
    assert [r.ts.year for r in rows] == [2025, 2026]


def test_continuations(spark):
    rows = parsed(spark, LOG.split("\n")[0] + "\n\tnext line\njunk\n\t more\n" + LOG.split("\n")[1])
    assert len(rows) == 2 and rows[0].message.endswith("\nnext line\nmore") and "junk" not in rows[0].raw_line
    big = parsed(spark, LOG.split("\n")[0] + "\n" + ("\t" + "x" * 2048 + "\n") * 50 + LOG.split("\n")[1])
    assert len(big) == 2 and "continuation truncated" in big[0].raw_line and len(big[0].raw_line) < 32768 + 4096


def test_event_log(spark):
    text = '65550 appliance update ASSERT NA "Firmware" "2024-01-15 14:20:48.019561540 UTC"\nLOG header\n7 s t e critical "m" "bad time"\n8 s t e Error "m" "2024-01-15 14:20:48 UTC"'
    files = spark.createDataFrame([("e", text.replace("update ASSERT", "ASSERT x"))], "source_file string, content string")
    rows = L.parse_events(L.lines(files)).orderBy("line_number").collect()
    assert [(r.severity, r.msg_code) for r in rows] == [("warning", "65550"), ("err", "8")] and rows[0].ts.microsecond == 19561


@pytest.fixture(scope="module")
def logs(spark):
    files = spark.createDataFrame([("ltm", LOG)], "source_file string, content string")
    return L.parse_logs(L.lines(files), now()).withColumn("id", F.col("line_number").cast("long"))


def test_search(logs):
    assert S.filtered(logs).count() == 4
    assert S.filtered(logs, search="monitor status down").count() == 1
    assert S.filtered(logs, search='"-pool* (member:').count() == 3
    assert S.filtered(logs, severity="err").count() == 2 and S.filtered(logs, msg_code="0107").count() == 2 and S.filtered(logs, msg_code="01%").count() == 0
    page = S.search_page(logs, 3).collect()
    assert len(page) == 3 and page[0].capped and not S.search_page(logs, 3, 3).collect()[0].capped
    assert {(r.facet, r.value) for r in S.facets(logs).collect()} >= {("severity", "err"), ("process", "mcpd"), ("process", "tmm")}


def test_rules(logs):
    rules = R.load_rules("""
rules:
  - {name: flap, severity: warning, category: ltm, patterns: [{msg_code: "01070638"}, {msg_code: "01070727"}], correlation: {type: paired, max_window_minutes: 30}}
  - {name: none_left, severity: critical, category: ltm, patterns: [{msg_code: "0101"}, {regex: "NO MEMBERS"}]}
""")
    simple = R.simple_findings(logs, rules)
    row = simple.collect()[0]
    assert (row.rule, row.hits, len(row.samples)) == ("none_left", 4, 4)
    pair = R.paired_finding(logs, rules[0], ["hostname"]).collect()[0]
    assert pair.hits == 1 and pair.first_seen == dt.datetime(2026, 6, 1, 10, 0) and pair.last_seen.minute == 5
    found = R.ordered(simple.select("rule", "hits").union(R.paired_finding(logs, rules[0], ["hostname"]).select("rule", "hits")), rules)
    assert [r.rule for r in found.collect()] == ["none_left", "flap"]
    assert R.load_rules("platform: other\nrules: [{name: x}]", "this") == []
    assert R.simple_findings(logs, []).count() == 0


@pytest.mark.parametrize(("a", "b", "n"), [([0], [1799], 1), ([0], [1800], 0), ([0, 10], [5], 1), ([100], [0], 1), ([0, 5000], [4000, 5100], 1)])
def test_greedy_pairs(a, b, n):
    assert len(R.greedy_pairs(a, b, 1800)) == n
    assert len(R.greedy_pairs([5], [5], 1800, [1], [1])) == 0


def test_streaming_counts_are_the_batch_counts(spark, tmp_path):
    from brindle.streaming import logs as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(LOG)
    rows = stream.counts(stream.log_stream(spark, str(tmp_path / "in"), now()))
    q = rows.writeStream.outputMode("complete").format("memory").queryName("log_counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.start.minute, r.severity, r.n) for r in spark.table("log_counts").collect()} == {(0, "notice", 1), (0, "err", 1), (5, "notice", 1), (5, "err", 1)}
