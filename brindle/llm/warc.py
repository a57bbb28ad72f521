"""Legacy archive converter: ARC records of either version to WARC, and WARC archives written and read by Spark.

An ARC file begins with a version block, which says whether its header lines have five fields (version 1) or ten
(version 2); every record's last field declares the length of what follows. From such a line the converter makes the
fields that WARC asks for and ARC lacks: a record id from the archive's name and the record's offset, so that it is the
same whenever it is made, an ISO timestamp, a type by scheme and content, and digests of the block and the payload.

Of records with equal payloads of at least a thousand bytes, the one with the largest page id is the response and the
others revisit it. Payloads aren't gathered by group: groups are sums by digest, and only the target goes back.

Archives are written by Spark's text writer, some megabytes of records a row, so they can lie in any store that Spark
writes to. A file is bounded in bytes (but for a single larger record). With members, each record is a gzip member, as
readers that jump to a record need it, and an empty member stands between rows; the files' names end as the text writer
ends them. Without, each file is one gzip stream. Files are read back one at a time, streaming through the records by
declared length.

Payloads are never cut to disk nor shuffled, but for a join when there are many groups: digests are worked out in a first
pass, and pages are converted again when they are written. So pages must come in the same order when they are read
again, as those of files do.

Defined results: null html is an empty payload; a null url becomes urn:page:<id>; blanks in urls are escaped; of rows
that repeat both page id and payload, one is the response; a null page_id stays null and is never preferred; a record
that ends before its declared length is kept with WARC-Truncated; very long html is a record like any other, alone in
its row; empty tables give empty ones; further columns don't disturb, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import kernel
from brindle.llm.common import cut, shared_folder, table

#: Fields of a header line by version: fixed by the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    offset: int
    fields: dict[str, str]
    block: bytes
    truncated: bool


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, plain or gzipped (as a whole or by record). The first is the version block.

    A header line is cut from its right end, as old urls may have blanks. Raises ValueError for a file without a
    version block or a header line that isn't one.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    version, at = 0, 0
    while True:
        line = stream.readline()
        if not line:
            return
        start, at = at, at + len(line)
        if line.strip() == b"":
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not version:
            if not text.startswith("filedesc://"):
                raise ValueError("an ARC file begins with filedesc://")
            length = text.rsplit(" ", 1)[-1]
        names = ARC_FIELDS.get(version, ())
        parts = text.rsplit(" ", len(names) - 1) if version else [length]
        if version and len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at {start}: {text[:80]!r}")
        size = int(parts[-1])
        block = stream.read(size)
        at += len(block)
        if not version:
            version = int(block.split(b" ", 1)[0])
            names = ARC_FIELDS[version]
            parts = text.rsplit(" ", len(names) - 1)
        yield ArcRecord(version, start, dict(zip(names, parts, strict=True)), block, len(block) < size)


def write_arc(name: str, version: int, records: list[tuple[str, str, bytes]], date: str) -> bytes:
    """An ARC file of records (url, content type, block)."""
    out = io.BytesIO()

    def put(url: str, kind: str, block: bytes) -> None:
        own = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(block))}
        out.write(" ".join(own[f] for f in ARC_FIELDS[version]).encode("utf-8", "surrogateescape") + b"\n" + block + b"\n")

    put(f"filedesc://{name}", "text/plain", f"{version} 0 brindle\n{' '.join(ARC_FIELDS[version])}\n".encode())
    for record in records:
        put(*record)
    return out.getvalue()


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{archive}:{offset}'.encode()).digest()[:16], version=5)}>"


def timestamp(date: str) -> str:
    """YYYYMMDDhhmmss, or its beginning, as WARC writes time; the epoch if it is none."""
    d = date if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of an HTTP block; no head if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(p + len(e)) for e in (b"\r\n\r\n", b"\n\n") if (p := block.find(e)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def warc_record(kind: str, own_id: str, fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record without the two line ends that close it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, **fields, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v != "")
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, plain or gzipped."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("a WARC record ends before its length")
        yield head, block


# --- over DataFrames ---

_RECORDS = "archive string, at long, page_id long, kind string, url string, ip string, date string, mime string, digest string, payload_bytes long, truncated boolean, head binary, payload binary"


def arc_segments(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """(archive, content): ARC files of a few MB of the pages (page_id, url, html), of either version by turns."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in kernel.pieces(batch, "html", 4 << 20):
                records = []
                for page, url, html in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    body = (html or "").encode("utf-8", "surrogatepass")
                    own = "" if page is None else f"X-Page-Id: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode()
                    clean = "%20".join((url or f"urn:page:{page}").split()) or "urn:page:"
                    records.append((clean, "text/html", head + body))
                name = f"segment-{part:06d}-{k:06d}.arc"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(name, 1 + k % 2, records, date)], pa.binary())], names=["archive", "content"])
                k += 1

    return pages.select("page_id", "url", "html").mapInArrow(run, "archive string, content binary")


def converted(segments: DataFrame, whole: bool = True) -> DataFrame:
    """The records of ARC files (archive, content) with what WARC asks for; head and payload are null if not whole."""

    def rows(archive, content):
        for r in read_arc(content):
            f = r.fields
            head, payload = split_http(r.block)
            info = f["URL"].startswith("filedesc://")
            kind = "warcinfo" if info else "response" if head else "resource"
            page = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), None)
            yield archive, r.offset, page, kind, f["URL"], f["IP-address"], timestamp(f["Archive-date"]), f["Content-type"], hashlib.sha1(payload).hexdigest(), len(payload), r.truncated, head if whole else None, payload if whole else None

    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in _RECORDS.split(", ")]

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                columns = list(zip(*rows(archive.as_py(), content.as_py()), strict=True))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return segments.mapInArrow(run, _RECORDS)


def deduplicated(records: DataFrame, least_bytes: int = 1000, broadcast_groups: int = 50_000, narrow: DataFrame | None = None) -> DataFrame:
    """records with target (archive, at, page_id) for those that revisit another. The groups' table is broadcast only up
    to so many rows of some 100 bytes; otherwise Spark joins by the digest and can split a hot one. narrow: the same
    records, if it is cheaper to read their digests there."""
    place = F.struct(F.col("page_id"), F.col("archive"), F.col("at"))
    big = (narrow or records).where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    groups = cut(big.groupBy("digest").agg(F.max(place).alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"))
    groups = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    joined = records.join(groups, "digest", "left")
    revisit = F.col("target").isNotNull() & (F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes) & ~F.col("target").eqNullSafe(place)
    return joined.withColumn("target", F.when(revisit, F.col("target")))


#: Records of so many bytes are one row of the writer, and so many rows one file.
_ROW, _ROWS = 4 << 20, 16
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def write_warc(records: DataFrame, path: str, members: bool = False) -> None:
    """Writes gzipped WARC files under path; records as of deduplicated()."""

    def made(r) -> bytes:
        fields = {"WARC-Date": r["date"], "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Truncated": "length" if r["truncated"] else ""}
        own, kind, payload = record_id(r["archive"], r["at"]), r["kind"], r["payload"]
        sha = "sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode()
        if kind == "warcinfo":
            fields = {"WARC-Date": r["date"], "WARC-Filename": r["archive"], "Content-Type": "application/warc-fields"}
            payload = b"software: brindle\r\nformat: WARC/1.1 from ARC\r\n"
        elif r["target"]:
            t = r["target"]
            fields |= {"WARC-Payload-Digest": sha, "WARC-Profile": REVISIT, "WARC-Refers-To": record_id(t["archive"], t["at"]), "X-Refers-To-Page-Id": str(t["page_id"]) if t["page_id"] is not None else "", "X-Payload-Length": str(r["payload_bytes"]), "Content-Type": "application/http; msgtype=response"}
            kind, payload = "revisit", b""
        else:
            fields |= {"WARC-Payload-Digest": sha, "Content-Type": "application/http; msgtype=response" if r["head"] else r["mime"]}
        return warc_record(kind, own, fields, r["head"] + payload)

    def row(out: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(gzip.compress(x + _END, 6, mtime=0) for x in out) if members else _END.join(out)
        return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["records"])

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                out.append(made(batch.slice(i, 1).to_pylist()[0]))
                size += len(out[-1])
                if size > _ROW:
                    yield row(out)
                    out, size = [], 0
            if out:
                yield row(out)

    text = records.mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    write = text.write.option("maxRecordsPerFile", _ROWS)
    if members:
        write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("iso-8859-1")).text(path)
    else:
        write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the response and revisit records of WARC files under path say of their pages; digests are checked."""

    def rows(content):
        for head, block in read_warc(content):
            kind = head["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, payload = split_http(block)
            declared = base64.b32decode(head["warc-payload-digest"].partition(":")[2])
            if kind == "response" and hashlib.sha1(payload).digest() != declared:
                raise ValueError(f"{head['warc-record-id']}: the payload isn't what its digest says")
            page = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), None)
            to = head.get("x-refers-to-page-id")
            yield page, len(payload) if kind == "response" else int(head["x-payload-length"]), declared.hex(), kind, int(to) if to else None, head["warc-target-uri"], head["warc-record-id"]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id"]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*rows(content.as_py()), strict=True))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay in the shared folder, under a new name each time; who runs it again and again removes them."""
    segments = arc_segments(table(spark, sf_dir, "pages"))
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(deduplicated(converted(segments), narrow=converted(segments, whole=False)), path, members=True)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN first END AS refers_to
FROM (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place FROM p) p LEFT JOIN g USING (payload_digest)
"""
