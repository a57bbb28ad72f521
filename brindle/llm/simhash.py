"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Two fingerprints that differ
in at most 2r bits have a number in common that differs from either in at most r: so each distinct fingerprint emits
all its variants within half the radius, the variants are shuffled, and fingerprints that meet on a variant are
verified. Copies collapse to one fingerprint first, and at most 65 fingerprints can meet on a variant (the variant's
own ball), so no group is large, however many near copies there are. In a group each fingerprint is linked with the
next smaller one, which joins the same components as all pairs would.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer than three words are
one shingle; repeated rows appear once each; a null doc_id is in a component but is never its smallest id; very long
texts are hashed whole, a bounded number of shingles at once; an empty table gives an empty table; further columns
don't disturb, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import kernel
from brindle.llm.common import components, cut, fresh, table
from brindle.llm.near import Near, near_links, sketched

_SIGNED = np.int64


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return 0
    joined, n = b" ".join(own), max(1, len(own) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(own)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, at = np.zeros(64, np.int64), 0
    while at < n:  # a bounded number of hashes at once
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        at += 65536
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0].astype(_SIGNED))


def fingerprints(docs: DataFrame, name: str, keep_text: bool = False) -> DataFrame:
    """docs with the fingerprint (bigint) of each text under that name."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches):
        for batch in batches:
            for piece in kernel.pieces(batch):
                texts = pc.fill_null(piece.column("text"), "").to_pylist()
                columns = [piece.column(f.name) for f in kept] + [pa.array([fingerprint(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that join every two of the distinct fingerprints (column fp) at radius or fewer differing bits."""
    if radius not in (2, 3):
        raise ValueError("half the radius must be 1: radius 2, or 3 with the links of 2")
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    spread = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.expr("fp ^ mask").alias("variant"))
    from pyspark.sql import Window

    met = spread.withColumn("b", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    return met.where(F.col("b").isNotNull() & (F.bit_count(F.expr("fp ^ b")) <= 2)).select(F.col("fp").alias("a"), "b").distinct()


def print_components(marked: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in marked (doc_id, fp): root is the smallest fingerprint
    of its component, component_id the smallest doc_id among all documents of the component. Components are those of
    the links (a, b), by default of the fingerprints within the radius."""
    own = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(ball_links(own.select("fp")) if links is None else links)
    rooted = cut(own.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = cut(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), "fp"))
    found = marked.join(print_components(marked), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, plan: Near | None = None) -> DataFrame:
    """docs with one document of each component of near copies by five-word shingles (brindle.llm.near): that with the
    smallest doc_id (nulls last), then the smallest row hash.

    Only ids and hashes are compared: they are aggregated by fingerprint, then by component. The documents that go are
    found by an anti-join on what identifies a row's content; their ids and hashes are broadcast if their count allows.
    Of repeated rows one stays. Null and empty texts are copies of each other; very long texts are compared whole; an
    empty table gives an empty table; further columns stay, whatever their names.
    """
    plan, key, h = plan or Near(), "__id", "__row"
    names = {x: fresh(docs.columns, x) for x in (key, h)}
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    marked = cut(sketched(docs.select("doc_id", "text", whole.alias(h)), plan, ["doc_id", h]))
    links = near_links(docs, marked, whole, plan)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias(key), F.col(h)))
    best = marked.groupBy("fp").agg(first.alias("best")).join(print_components(marked, links), "fp").groupBy("root").agg(F.min("best").alias("best"))
    best = best.select(F.col(f"best.{key}").alias(names[key]), F.col(f"best.{h}").alias(names[h]))
    every = marked.select(F.col("doc_id").alias(names[key]), F.col(h).alias(names[h])).distinct()
    again = best.select(F.col(names[key]).alias("k"), F.col(names[h]).alias("r"))
    bad = cut(every.join(again, F.col(names[key]).eqNullSafe(F.col("k")) & (F.col(names[h]) == F.col("r")), "left_anti"))
    bad = F.broadcast(bad) if bad.count() <= plan.broadcast_rows else bad
    kept = docs.join(bad, docs["doc_id"].eqNullSafe(bad[names[key]]) & (whole == bad[names[h]]), "left_anti")
    # Only if an id and row hash come more than once need the kept rows be made distinct.
    repeated = marked.groupBy("doc_id", h).count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
