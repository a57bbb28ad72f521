"""Files bounded by bytes, a gzip member a record, and pages of several MB."""

import gzip
import hashlib

from brindle.llm import warc as W


def test_large_pages(spark, tmp_path):
    big = ["".join(f"<p>{i} {k}</p>" for k in range(300_000)) for i in range(3)]
    pages = [(i, f"http://h/{i}", big[i % 3]) for i in range(7)] + [(10 + i, None, f"<b>{i}</b>" * 400) for i in range(300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in W.op1_arc_to_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest() for i, _, h in pages)
    assert [got[i].record_type for i in range(7)] == ["revisit"] * 4 + ["response"] * 3 and got[0].refers_to == 6 and got[1].refers_to == 4


def test_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<i>é{i}</i>" * 3000) for i in range(900)], "page_id long, url string, html string").coalesce(1)
    records = W.deduplicated(W.converted(W.arc_segments(pages)))
    W.write_warc(records, f"{tmp_path}/members", members=True)
    W.write_warc(records, f"{tmp_path}/stream")
    whole = [sorted(p.read_bytes() for p in (tmp_path / d).glob("part-*")) for d in ("members", "stream")]
    both = [sorted((h["warc-record-id"], h["warc-block-digest"], hashlib.sha1(b).digest()) for content in c for h, b in W.read_warc(content)) for c in whole]
    assert both[0] == both[1] and len(both[0]) > 900
    first = whole[0][0]
    assert first.count(b"\x1f\x8b\x08") >= sum(1 for _ in W.read_warc(first))
    # the second record is found at its member's start
    at = first.index(b"\x1f\x8b\x08", 10)
    assert gzip.decompress(first[at:]).startswith(b"WARC/1.1\r\n")
