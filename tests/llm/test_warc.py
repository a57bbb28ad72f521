import gzip
import hashlib
from collections import Counter

import pytest

from brindle.llm import warc as W

_INFO = b"1 0 Some Org\nURL IP-address Archive-date Content-type Archive-length\n"
_PAGE = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>short body</p>"
V1 = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n%s\n" % (len(_INFO), _INFO)
V1 += b"http://a.example/x y 127.10.100.2 19961104142103 text/html %d\n%s\n" % (len(_PAGE), _PAGE)
V1 += b"dns:a.example 10.0.0.1 19961104142104 text/dns 6\na b c\n\n"


def test_versions_and_declared_lengths():
    rows = list(W.read_arc(V1))
    assert [r.version for r in rows] == [1, 1, 1] and rows[1].fields["URL"] == "http://a.example/x y" and rows[1].fields["Archive-date"] == "19961104142103"
    assert W.split_http(rows[1].block)[1] == b"<p>short body</p>" and rows[2].block == b"a b c\n"
    for version in (1, 2):
        bodies = [b"", b"x\n\nfiledesc://not one 1 2 3 4\n", bytes(range(256)) * 9]
        made = W.write_arc("n.arc", version, [(f"u{i}", "image/gif", b) for i, b in enumerate(bodies)], "20200102030405")
        for content in (made, gzip.compress(made)):
            back = list(W.read_arc(content))
            assert [r.block for r in back[1:]] == bodies and {r.version for r in back} == {version} and not any(r.truncated for r in back)
        assert list(W.read_arc(made[:-5]))[-1].truncated
        assert [made[r.offset : r.offset + 2] for r in list(W.read_arc(made))[1:]] == [b"u0", b"u1", b"u2"]


def test_files_that_are_not_arc():
    with pytest.raises(ValueError):
        list(W.read_arc(b"WARC/1.0\r\n"))
    with pytest.raises(ValueError):
        list(W.read_arc(W.write_arc("n", 1, [], "2020") + b"no header line\n"))


def test_timestamps_and_ids():
    assert W.timestamp("19961104142103") == "1996-11-04T14:21:03Z" and W.timestamp("199611041421") == "1996-11-04T14:21:00Z" and W.timestamp("1996") == "1996-01-01T00:00:00Z" and W.timestamp("?").startswith("1970")
    assert W.record_id("a", 1) == W.record_id("a", 1) != W.record_id("a", 2)
    record = W.warc_record("response", "<urn:x>", {"WARC-Date": "d", "WARC-Truncated": ""}, b"\x00\r\n\r\nWARC/1.1\r\n") + W._END
    assert [(h["warc-type"], b) for h, b in W.read_warc(record * 2)] == [("response", b"\x00\r\n\r\nWARC/1.1\r\n")] * 2


def test_conversion_of_given_archives(spark, tmp_path):
    files = spark.createDataFrame([("old.arc", bytearray(V1)), ("two.arc", bytearray(W.write_arc("two.arc", 2, [("ftp://x/y", "image/gif", bytes(range(256)))], "2001")))], "archive string, content binary")
    rows = {r.url: r for r in W.converted(files).collect()}
    assert rows["dns:a.example"].kind == "resource" and rows["http://a.example/x y"].kind == "response" and rows["ftp://x/y"].date == "2001-01-01T00:00:00Z" and rows["filedesc://old.arc"].kind == "warcinfo"
    W.write_warc(W.deduplicated(W.converted(files)), f"{tmp_path}/out")
    got = [x for p in (tmp_path / "out").glob("*.gz") for x in W.read_warc(p.read_bytes())]
    assert Counter(h["warc-type"] for h, _ in got) == {"warcinfo": 2, "resource": 2, "response": 1}
    raw = next(b for h, b in got if h.get("warc-target-uri") == "ftp://x/y")
    assert raw == bytes(range(256))


def test_query(spark, folder):
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    groups = {}
    for i, h in pages:
        if len((h or "").encode()) >= 1000:
            groups.setdefault(sha(h), []).append(i)
    want, used = Counter(), set()
    for i, h in pages:
        own = groups.get(sha(h), [i])
        first = max((x for x in own if x is not None), default=None)
        response = i == first and (sha(h) not in used or sha(h) not in groups)
        if response:
            used.add(sha(h))
        want[i, len((h or "").encode()), sha(h), "response" if response else "revisit", None if response else first] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.op1_arc_to_warc(spark, folder).collect())
    assert got == want and sum(1 for k in got.elements() if k[3] == "revisit") == 3


def test_joined_groups_and_empty(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    records = W.converted(W.arc_segments(pages))
    targets = [sorted(str((r.page_id, r.target and r.target.page_id)) for r in W.deduplicated(records, broadcast_groups=n).collect()) for n in (0, 1000)]
    assert targets[0] == targets[1]
    pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op1_arc_to_warc(spark, str(tmp_path)).count() == 0
