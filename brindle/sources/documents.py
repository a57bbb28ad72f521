"""Documents of many formats as DataFrames: JSON, Markdown, XML indexes, API specifications, pages of bugs, vectors."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a file; malformed ones go. file tells the order."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def by_url(docs: DataFrame) -> DataFrame:
    """One document of each url: that of the last file in order of names."""
    return docs.groupBy("url").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "url"]), "file").alias("d")).select("url", "d.*")


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def articles(texts: DataFrame, hosts: list[str], least: int = 50) -> DataFrame:
    """Markdown articles (file, text): id is the file's stem, the title comes from a line `Knnn: title` or is the id,
    the url is the first to a known host; advisories named in the text are keywords; short ones go."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    titled = F.regexp_extract("text", r"(?m)^#*\s*(K\w+):\s+(.+)$", 2)
    url = F.regexp_extract("text", r"https?://(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")[^\s)\"'>]*", 0)
    cves = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(CVE-\d{4}-\d+)\b"), F.lit(1)), F.upper)))
    rows = texts.select(stem.alias("doc_id"), F.substring(F.when(titled == "", stem).otherwise(F.trim(titled)), 1, 500).alias("title"), F.nullif(url, F.lit("")).alias("url"), cves.alias("keywords"), F.col("text").alias("content"))
    return rows.where(F.length("content") >= least).withColumn("content_hash", F.sha2("content", 256))


def heading_chunks(texts: DataFrame, most: int = 1500) -> DataFrame:
    """Chunks of texts (file, text), a new one at each heading and after most characters; (file, chunk_no, heading, text)."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("i")
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("part", F.sum(F.when(F.col("line").startswith("#"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy("file", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("sub", F.floor(F.coalesce(F.sum(F.length("line") + 1).over(inside), F.lit(0)) / most))
    chunks = lines.groupBy("file", "part", "sub").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"), F.min(F.when(F.col("line").startswith("#"), F.regexp_replace("line", r"^#+\s*", ""))).alias("heading"))
    order = Window.partitionBy("file").orderBy("part", "sub")
    return chunks.where(F.trim("text") != "").withColumn("chunk_no", F.row_number().over(order)).select("file", "chunk_no", "heading", "text")


def rfc_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an XML index: id in lower case, number without zeros, lists of keywords and authors."""
    schema = "`doc-id` string, title string, author array<struct<name string>>, keywords struct<kw array<string>>, obsoletes struct<`doc-id` array<string>>, `current-status` string"
    rows = spark.read.format("xml").option("rowTag", "rfc-entry").schema(schema.replace("<name string>", "<name: string>").replace("<kw array", "<kw: array").replace("<`doc-id` array", "<`doc-id`: array")).load(path)
    return rows.select(F.lower(F.trim("doc-id")).alias("doc_id"), F.regexp_replace(F.regexp_extract("doc-id", r"(\d+)", 1), "^0+", "").alias("number"), F.trim("title").alias("title"), F.col("author.name").alias("authors"), F.col("keywords.kw").alias("keywords"), F.transform("obsoletes.doc-id", F.lower).alias("obsoletes"), F.col("current-status").alias("status"))


def xml_objects(spark: SparkSession, path: str, tag: str, fields: list[str]) -> DataFrame:
    """Records of one tag of XML files, their fields as map<string,string>; entities aren't resolved by Spark's reader,
    broken files end where they break."""
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(", ".join(f"`{f}` string" for f in fields)).load(path)
    entries = [x for f in fields for x in (F.lit(f), F.col(f"`{f}`"))]
    return rows.select(F.lit(tag).alias("category"), F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("fields"), F.monotonically_increasing_id().alias("pos"))


def api_specs(specs: DataFrame, license_marks: tuple[str, ...], most: int = 16_000) -> DataFrame:
    """(file, title, endpoints, properties, content) of API specifications (file, text): distinct summaries of
    endpoints and descriptions of properties in order, licence text cut off, content cut to most characters."""
    op = "struct<summary:string,description:string>"
    spec = F.from_json("text", f"struct<info:struct<title:string,description:string>,paths:map<string,map<string,{op}>>,definitions:map<string,struct<description:string,properties:map<string,struct<description:string>>>>>")
    s = specs.withColumn("s", spec)
    summaries = F.flatten(F.transform(F.map_values("s.paths"), lambda m: F.transform(F.map_values(m), lambda o: F.coalesce(o["summary"], F.lit("")))))
    props = F.flatten(F.transform(F.map_values("s.definitions"), lambda d: F.transform(F.map_values(F.coalesce(d["properties"], F.expr("map()").cast("map<string,struct<description:string>>"))), lambda p: X.cut_at_first(F.coalesce(p["description"], F.lit("")), license_marks))))
    none = F.expr("cast(array() as array<string>)")
    out = s.select("file", F.col("s.info.title").alias("title"), X.distinct_ordered(F.coalesce(summaries, none)).alias("endpoints"), X.distinct_ordered(F.coalesce(props, none)).alias("properties"), X.cut_at_first(F.coalesce("s.info.description", F.lit("")), license_marks).alias("about"))
    return out.withColumn("content", F.substring(F.concat_ws("\n\n", F.nullif("about", F.lit("")), F.array_join("endpoints", "\n"), F.array_join("properties", "\n")), 1, most)).drop("about")


def bug_pages(pages: DataFrame, fetch_log: DataFrame, least: int = 1000) -> DataFrame:
    """Bug pages (bug_id, html, mtime) with title, severity, sections of h2/h3, article references and the date of the
    fetch log's last line or the file; short pages, and those without severity and sections, go."""
    field = lambda name: F.nullif(X.strip_tags(F.regexp_extract("html", rf"(?is)<b>\s*{name}\s*:?\s*</b>\s*:?\s*([^<]*)", 1)), F.lit(""))
    seen = fetch_log.groupBy("bug_id").agg(F.max_by("ts", "line").alias("ts"))
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)\b(K\d{4,})\b"), F.lit(1)), F.upper)))
    heads = F.regexp_extract_all("html", F.lit(r"(?is)<h[23][^>]*>(.*?)</h[23]>"), F.lit(1))
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)</h[23]>(.*?)(?=<h[23]|$)"), F.lit(1))
    rows = pages.where(F.length("html") >= least).join(seen, "bug_id", "left")
    rows = rows.select("bug_id", X.page_title(F.col("html")).alias("title"), field("Severity").alias("severity"), _merged(F.transform(heads, X.strip_tags), F.slice(F.transform(bodies, X.strip_tags), F.lit(1), F.size(heads))).alias("sections"), refs.alias("refs"), F.coalesce(F.substring("ts", 1, 10), F.date_format("mtime", "yyyy-MM-dd")).alias("fetched"))
    return rows.where((F.size("sections") > 0) | F.col("severity").isNotNull())


def _merged(heads: Column, bodies: Column) -> Column:
    """A map of bodies by heading; bodies under equal headings are joined by a line end."""
    both = F.arrays_zip(heads.alias("h"), bodies.alias("b"))
    of = lambda h: F.array_join(F.transform(F.filter(both, lambda x: x["h"] == h), lambda x: x["b"]), "\n")
    return F.map_from_entries(F.transform(F.array_distinct(heads), lambda h: F.struct(h, of(h))))


def bug_content(bug_id: Column, severity: Column, sections: Column, refs: Column) -> Column:
    """Labelled meta line, sections in order of their names, and references, a blank line apart."""
    named = F.transform(F.array_sort(F.map_entries(sections)), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"]))
    meta = F.concat(F.lit("Bug "), bug_id, F.coalesce(F.concat(F.lit(" | Severity: "), severity), F.lit("")))
    return F.concat_ws("\n\n", meta, F.array_join(named, "\n\n"), F.when(F.size(refs) > 0, F.concat(F.lit("References: "), F.array_join(refs, ", "))))


def keywords(text: Column) -> Column:
    """array<string> of a keywords column: a JSON array, or words."""
    listed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.trim(text).startswith("["), F.coalesce(listed, F.split(F.trim(text), r"\s+"))).otherwise(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))


def vectors(spark: SparkSession, blob: str, doc_ids: list[str], dims: int) -> DataFrame:
    """(doc_id, chunk_idx, v) of a file of little-endian float32 rows; doc_ids name each row's document. Raises
    ValueError if the sizes don't agree."""
    content = spark.read.format("binaryFile").load(blob).select("content").first()["content"]
    flat = np.frombuffer(content, "<f4")
    if len(flat) != len(doc_ids) * dims:
        raise ValueError("the vector file and its manifest disagree")
    chunk = pd.Series(doc_ids).groupby(doc_ids).cumcount()
    v = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), dims).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"doc_id": pa.array(doc_ids, pa.string()), "chunk_idx": pa.array(chunk.to_numpy(), pa.int64()), "v": v}))


def sitemap_locations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def sitemaps(files: DataFrame, wanted: str = "") -> DataFrame:
    """(file, url) of sitemap files (path, content), gunzipped if they are gzipped, each url once; wanted: a pattern
    that urls have."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string())], names=["file", "text"])

    texts = files.select("path", "content").mapInArrow(run, "file string, text string")
    urls = texts.select("file", F.explode(sitemap_locations(F.col("text"))).alias("url")).select("file", X.unescape(F.col("url")).alias("url"))
    return urls.where(F.col("url").rlike(wanted)).dropDuplicates(["url"])


def contents(html: Column) -> Column:
    """array<struct<url, title>> of the links of a table of contents: those with a title, each url once, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)(<a\s[^>]*?href="[^"#]+[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    made = F.transform(found, lambda a: F.struct(F.regexp_extract(a, r'(?is)href="([^"#]+)', 1).alias("url"), X.strip_tags(a).alias("title")))
    full = F.filter(made, lambda x: x["title"] != "")
    return F.filter(full, lambda x, i: F.array_position(F.transform(full, lambda y: y["url"]), x["url"]) == i + 1)


def robots_rules(text: str, agent: str = "*") -> tuple[list[tuple[str, bool]], float | None]:
    """(path prefix, allowed) rules and crawl delay for an agent; a group of its name goes before that of *."""
    groups: dict[str, list] = {}
    delays: dict[str, float] = {}
    names: list[str] = []
    fresh = True
    for line in text.splitlines():
        k, _, v = line.partition("#")[0].partition(":")
        k, v = k.strip().lower(), v.strip()
        if k == "user-agent":
            names = [v.lower()] if not fresh else [*names, v.lower()]
            fresh = True
        elif k in ("allow", "disallow"):
            fresh = False
            for n in names:
                if v or k == "allow":
                    groups.setdefault(n, []).append((v, k == "allow"))
        elif k == "crawl-delay":
            fresh = False
            for n in names:
                delays[n] = float(v)
    own = next((n for n in {**groups, **delays} if n != "*" and n in agent.lower()), "*")
    return groups.get(own, []), delays.get(own)


def robots_allow(rules: list[tuple[str, bool]], path: str) -> bool:
    """The longest prefix decides; none: allowed."""
    met = [(len(p), ok) for p, ok in rules if path.startswith(p)]
    return max(met)[1] if met else True
