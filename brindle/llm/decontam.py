"""Benchmark decontamination with SimHash item-sized windows, multi-index Hamming blocks and exact verification,
with DataFrame functions only.

A document is contaminated by an item if a window of the item's number of words has a weighted (multiset) Jaccard
similarity of 0.8 or more to it on shingles of five words. Words are runs of letters and digits in lower case, so that
case, punctuation and line ends don't hide a copy.

1. Windows: of every length that items have, those that begin at an anchor, a shingle of some item of that length, or
   the document's last one. A window without an anchor has similarity 0, and moving a window right to its first anchor
   (or to the end) loses no common shingle, so none is missed. Which item an anchor came from isn't carried along.
2. SimHash: each window gets a fingerprint of its shingles, repeats included.
3. Multi-index: fingerprints are cut into blocks. Of two within the radius, some block differs in at most radius //
   blocks bits, so items are spread over all values so near to their blocks, and an equi-join on length, block and
   value gives every pair within the radius; it is these pairs that are candidates. Those further apart go.
4. Exact: shingles of the candidates are compared as text, with their multiplicities.

The radius decides the recall: at similarity 0.8 two fingerprints differ in about 10 of 64 bits, with a deviation of 3;
see the README for the measured share.

Rows that are shuffled or cut are ids, hashes and places: texts are read again for the windows that matter.

Defined results: null and empty texts of documents and items match nothing; items with a null id match like any other;
a document that is shorter than an item is one window; items of fewer than five words are one shingle of all their
words; of windows that match equally well the first counts; repeated documents or items give one row for each pair of
ids; very long texts are searched whole, in time that grows with their length; empty tables give an empty table;
further columns don't disturb, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, fresh, table


@dataclass(frozen=True)
class Windows:
    width: int = 5
    similarity: float = 0.8
    #: Fingerprints that differ in more bits are no candidates.
    radius: int = 17
    blocks: int = 6
    #: Shingles of items are broadcast up to so many words in all (about 10 MB), else joined by shuffle.
    broadcast_words: int = 200_000
    #: Rows of ids, hashes and places (up to some 100 bytes each) are broadcast up to so many, else joined by shuffle.
    broadcast_rows: int = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hash(own: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(own, i + j) for j in range(width)])


def _hashes(own: Column, width: int) -> Column:
    """Hashes of all shingles of an array of at least width words."""
    return F.transform(F.sequence(F.lit(0), F.size(own) - width), lambda i: _hash(own, i, width))


def _print(hashes: Column) -> Column:
    """The fingerprint: a bit is set where over half of the hashes have it. Eight bits are counted at once, in lanes of a
    byte, for fewer than 128 hashes, where no lane can overflow into the next or the sign."""
    shift = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    step = F.lit(0x0101010101010101)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + shift(h, k).bitwiseAND(step)))
    few = lambda own, b: shift(F.get(own, b % 8), F.floor(b / 8).cast("int") * 8).bitwiseAND(F.lit(255))
    many = lambda b: F.size(F.filter(hashes, lambda h: shift(h, b).bitwiseAND(F.lit(1)) == 1))
    bit = lambda ones, b: F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    whole = lambda ones: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda mark, b: mark.bitwiseOR(bit(ones(b), b)))
    by_lanes = F.get(F.transform(F.array(lanes), lambda own: whole(lambda b: few(own, b))), F.lit(0))
    return F.when(F.size(hashes) < 128, by_lanes).otherwise(whole(many))


def _spans(plan: Windows) -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    edges = [64 * b // plan.blocks for b in range(plan.blocks + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def _blocks(mark: Column, plan: Windows) -> list[Column]:
    """The fingerprint's blocks, each with its place in the low bits."""
    return [F.shiftrightunsigned(mark, a).bitwiseAND(F.lit((1 << n) - 1)) * 64 + i for i, (a, n) in enumerate(_spans(plan))]


def _near_blocks(mark: Column, plan: Windows) -> Column:
    """All values of blocks that differ from the fingerprint's in at most radius // blocks bits."""
    flips = plan.radius // plan.blocks
    out = []
    for block, (_, n) in zip(_blocks(mark, plan), _spans(plan), strict=True):
        masks = F.array(*[F.lit(sum(64 << b for b in bits)).cast("long") for k in range(flips + 1) for bits in combinations(range(n), k)])
        out.append(F.transform(masks, block.bitwiseXOR))
    return F.flatten(F.array(*out))


def _texts(own: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(own) - width + 1), lambda i: F.array_join(F.slice(own, i, width), " "))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the value, which is worked out once a row: Spark would repeat it in every filter and column that uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def prepared(items: DataFrame, plan: Windows) -> DataFrame:
    """item_id, item (a key of id and text, as ids may be null), own (words), n and width of each item with a word; cut,
    as it is used several times."""
    own = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("own")).where("size(own) > 0")
    return cut(own.withColumn("n", F.size("own")).withColumn("width", F.least(F.lit(plan.width), F.col("n"))))


def _place(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has at most so many rows; df was cut."""
    return F.broadcast(df) if df.count() <= most else df


def _windows(docs: DataFrame, wanted: DataFrame, plan: Windows) -> DataFrame:
    """wanted (cut; doc_id, text_hash, n, at and more) with the window's words. Only texts that are wanted are split into
    words, once each."""
    own = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    placed = _place(wanted, plan.broadcast_rows)
    own = _once(own.join(placed, same, "left_semi"), "doc_words", words(F.col("text"))).drop("text")
    met = own.join(placed, same)
    return met.select(*wanted.columns, F.slice("doc_words", F.col("at") + 1, F.col("n")).alias("window"))


def starts(docs: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n, at): where windows of n words begin, for anchors (n, hash)."""
    own = _once(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "doc_words", words(F.col("text"))).drop("text").where(F.size("doc_words") >= width)
    at = own.select("doc_id", "text_hash", "doc_words", F.size("doc_words").alias("doc_n"), F.explode(F.sequence(F.lit(0), F.size("doc_words") - width)).alias("pos"))
    at = at.select("doc_id", "text_hash", "doc_n", "pos", _hash(F.col("doc_words"), F.col("pos"), width).alias("hash"))
    at = at.join(anchors, "hash")
    return at.select("doc_id", "text_hash", "n", F.greatest(F.lit(0), F.least(F.col("pos"), F.col("doc_n") - F.col("n"))).alias("at")).distinct()


def candidates(windows: DataFrame, full: DataFrame, plan: Windows) -> DataFrame:
    """(doc_id, text_hash, n, at, item) of windows (with print) and items (with item_print) within the radius, by blocks."""
    probes = windows.withColumn("block", F.explode(F.array(*_blocks(F.col("print"), plan))))
    spread = full.select("item", "item_print", F.col("item_n").alias("n"), F.explode(_near_blocks(F.col("item_print"), plan)).alias("block"))
    each = sum(comb(n, k) for _, n in _spans(plan) for k in range(plan.radius // plan.blocks + 1))
    met = probes.join(F.broadcast(spread) if full.count() * each <= plan.broadcast_rows else spread, ["n", "block"])
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= plan.radius).select("doc_id", "text_hash", "n", "at", "item").distinct()


def fingerprinted(docs: DataFrame, wanted: DataFrame, width: int, plan: Windows) -> DataFrame:
    """wanted with the windows' fingerprints."""
    window = _once(_windows(docs, wanted, plan), "hashes", _hashes(F.col("window"), width))
    return window.select("doc_id", "text_hash", "n", "at", _print(F.col("hashes")).alias("print"))


def item_prints(known: DataFrame, width: int) -> DataFrame:
    """item_id, item, item_n, item_hashes, item_print and item_shingles of the items whose shingles have that width."""
    own = known.where(F.col("width") == width)
    full = own.select("item_id", "item", F.col("n").alias("item_n"), "own", _hashes(F.col("own"), width).alias("item_hashes"))
    return full.withColumn("item_print", _print(F.col("item_hashes"))).withColumn("item_shingles", _texts(F.col("own"), width)).drop("own")


def matches(docs: DataFrame, items: DataFrame, plan: Windows | None = None) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, at): the best window of each document and item that match.

    docs have doc_id and text, items have item_id and text. at is the window's first word, counted from 0.
    """
    plan = plan or Windows()
    docs = docs.select("doc_id", "text")
    known = prepared(items, plan)
    sizes = known.groupBy("width").agg(F.sum("n").alias("words")).collect()  # one row a width
    put = F.broadcast if sum(r["words"] for r in sizes) <= plan.broadcast_words else (lambda df: df)
    found = None
    for width in sorted({r["width"] for r in sizes} or {plan.width}):
        full = cut(item_prints(known, width))
        anchors = full.select(F.col("item_n").alias("n"), F.explode("item_hashes").alias("hash")).distinct()
        windows = cut(fingerprinted(docs, cut(starts(docs, put(anchors), width)), width, plan).distinct())
        window = _windows(docs, cut(candidates(windows, full, plan)), plan).join(put(full.select("item", "item_id", "item_shingles")), "item")
        window = _once(window, "shingles", _texts(F.col("window"), width))
        times = lambda a, s: F.size(F.filter(a, lambda x: x == s))
        common = F.aggregate(F.array_distinct("item_shingles"), F.lit(0), lambda n, s: n + F.least(times("shingles", s), times("item_shingles", s)))
        score = common / (F.size("shingles") + F.size("item_shingles") - common)
        window = _once(window, "similarity", score).where(F.col("similarity") >= plan.similarity - 1e-9)
        best = window.select("doc_id", "text_hash", "item_id", "similarity", "at")
        found = best if found is None else found.union(best)
    least = F.min(F.struct((-F.col("similarity")).alias("s"), "at"))
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(least.alias("best"))
    return found.select("doc_id", "text_hash", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.at").alias("at"))


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of document and item that match."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def keep_clean(docs: DataFrame, items: DataFrame, plan: Windows | None = None) -> DataFrame:
    """docs without those that match an item. The decision depends on the text alone, so it goes back by its content:
    an anti-join on id and text hash whose one side has only the matches; they are broadcast if their count allows."""
    plan = plan or Windows()
    a, b = fresh(docs.columns, "__id"), fresh(docs.columns, "__text")
    bad = _place(cut(matches(docs, items, plan).select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct()), plan.broadcast_rows)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[a]) & (F.xxhash64(docs["text"]) == bad[b]), "left_anti")


#: Exact similarity of every window that shares a shingle with an item. DuckDB's lower() and Java's agree but for a few
#: letters whose case isn't one to one.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS v FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT k, item_id, len(v) AS n, least(5, len(v)) AS width, v FROM i WHERE len(v) > 0),
sh AS (SELECT k, shingle, count(*) AS times FROM (SELECT k, unnest(list_transform(range(1, n - width + 2), lambda j: array_to_string(v[j:j + width - 1], ' '))) AS shingle FROM it) GROUP BY 1, 2),
widths AS (SELECT DISTINCT width FROM it),
ds AS (SELECT r, width, unnest(range(0, len(w) - width + 1)) AS pos, unnest(list_transform(range(1, len(w) - width + 2), lambda j: array_to_string(w[j:j + width - 1], ' '))) AS shingle
       FROM dw, widths WHERE len(w) >= width),
hit AS (SELECT r, it.k, it.width, pos, shingle, it.n FROM ds JOIN sh USING (shingle) JOIN it ON it.k = sh.k AND it.width = ds.width),
begins AS (SELECT DISTINCT hit.r, k, hit.width, n, least(n, len(w)) AS window_n, greatest(0, least(pos, len(w) - n)) AS first_word FROM hit JOIN dw USING (r)),
c AS (SELECT b.r, b.k, b.first_word, shingle, count(*) AS times FROM begins b JOIN hit ON hit.r = b.r AND hit.k = b.k AND hit.pos BETWEEN b.first_word AND b.first_word + b.window_n - b.width GROUP BY ALL),
z AS (SELECT c.r, c.k, first_word, sum(least(c.times, sh.times)) AS common FROM c JOIN sh ON sh.k = c.k AND sh.shingle = c.shingle GROUP BY ALL),
s AS (SELECT r, k, max(common / ((window_n - width + 1) + (n - width + 1) - common)) AS similarity FROM z JOIN begins USING (r, k, first_word) GROUP BY ALL)
SELECT doc_id, item_id, max(similarity) AS similarity FROM s JOIN dw USING (r) JOIN it USING (k) WHERE similarity >= 0.8 - 1e-9 GROUP BY ALL
"""
