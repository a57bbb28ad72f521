"""Near copies by shingles of five words: SimHash ball hashing, then an exact join on prefixes, similarity verified on
whole shingle sets. No pair is lost and no group is capped.

Two texts are near copies if the Jaccard similarity of their sets of shingles is 0.8 or more. Links come in three steps,
each verified on 64-bit hashes of all shingles:

1. Texts with equal SimHash fingerprints, and fingerprints that ball hashing finds (as in op5), are linked.
2. All texts' shingles are put in one order, common ones last. Near copies share a shingle among the first
   n - ceil(0.8 n) + 1 of both, and where the first such is, enough shingles are left in both for the similarity. Of the
   texts that share such a shingle, each is tried with the one that has the fewest before it, so the least of its own;
   this makes large groups of near copies one component by a verification a text.
3. Of the shingles whose texts still lie in several components, all pairs of different components that sizes and
   positions allow are verified.

So the components are those of brute force, but for collisions of 64-bit hashes. What is common is told by one text in
`order_share`; this order is the same for all texts, and another one would give the same links with more or less work.
What grows with the square of a group's size is only the pairs of step 3: texts in different components whose rare
shingles still allow a similarity of 0.8.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import kernel
from brindle.llm.common import components, cut


@dataclass(frozen=True)
class Near:
    width: int = 5
    similarity: float = 0.8
    #: Hash functions of a sketch, in bands (no step uses them; sketches estimate similarity).
    bands: int = 16
    rows: int = 4
    #: One text in so many tells which shingles are common.
    order_share: int = 16
    #: At most so many shingles are put last; the rest is in the order of hashes.
    order_most: int = 2_000_000
    #: Kept for callers; groups of any size are joined without a cap.
    crowd: int = 16
    hubs: int = 4
    seed: int = 42
    #: The dropped documents (an id and a hash each) are broadcast up to so many, else joined by shuffle.
    broadcast_rows: int = 1_000_000


def _own(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(own: list[bytes], plan: Near, seen: dict | None = None) -> np.ndarray:
    """Hashes of the distinct shingles of a text's words, in order. Fewer words than the width are one shingle."""
    import xxhash

    if not own:
        return np.zeros(0, np.uint64)
    seen = {} if seen is None else seen
    for w in set(own).difference(seen):
        seen[w] = xxhash.xxh64_intdigest(w, plan.seed)
    h = np.fromiter(map(seen.__getitem__, own), np.uint64, len(own))
    width = min(plan.width, len(own))
    odd = np.random.default_rng(plan.seed).integers(1 << 62, 1 << 63, plan.width, dtype=np.uint64) | np.uint64(1)
    mixed = np.full(len(own) - width + 1, width, np.uint64)
    for j in range(width):  # the order of the words counts
        mixed = (mixed ^ h[j : j + len(mixed)]) * odd[j]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(hashes: np.ndarray, plan: Near) -> np.ndarray:
    rng = np.random.default_rng(plan.seed + 1)
    n = plan.bands * plan.rows
    a, b = (rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64) for _ in range(2))
    a |= np.uint64(1)
    least = np.full(n, (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] * a + b) >> np.uint64(32)).min(1))
    return least.astype(np.uint32).view(np.int32)


def _run(docs: DataFrame, fields: list[tuple[str, T.DataType]], make, keep: list[str]) -> DataFrame:
    """The columns to keep, and those that make(own words, seen words) gives of each text."""
    kept = [f for f in docs.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            for piece in kernel.pieces(batch, limit=2 << 20):
                seen: dict = {}
                rows = [make(_own(t), seen) for t in pc.fill_null(piece.column("text"), "").to_pylist()]
                kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32()), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
                made = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([piece.column(f.name) for f in kept] + made, names=[f.name for f in kept] + [name for name, _ in fields])

    return docs.mapInArrow(run, T.StructType([*kept, *[T.StructField(name, kind) for name, kind in fields]]))


def _key(own: list[bytes]) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(own), 7)).astype(np.int64)) if own else 0


def common(docs: DataFrame, plan: Near) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that come in several of the sampled texts, and how many texts each."""
    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(plan.order_share)) == 0).select("text").dropDuplicates()
    make = lambda own, seen: (shingles(own, plan, seen).view(np.int64),)
    counts = _run(texts, [("hashes", T.ArrayType(T.LongType()))], make, []).select(F.explode("hashes").alias("h")).groupBy("h").count()
    counts, least = cut(counts.where("count > 1")), 2
    while counts.where(F.col("count") >= least).count() > plan.order_most:
        least *= 2
    found = counts.where(F.col("count") >= least).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefix(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray], plan: Near) -> np.ndarray:
    """The first shingles in the common order, of which near copies share one."""
    h, n = often
    rank = np.zeros(len(hashes), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
        rank = np.where(h[at] == hashes, n[at], 0)
    most = len(hashes) - math.ceil(plan.similarity * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, rank))[:most]]


def print_of(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: the bits that over half of the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def bins(hashes: np.ndarray) -> bytes:
    """How many hashes begin with each value of so many bits that some two hashes share a value; 255 is 255 or more."""
    k = max(1, (len(hashes) // 2).bit_length())
    return np.minimum(np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> int:
    """A bound of how many hashes two sets share, from their bins."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    x, y = (np.where(v == 255, 1 << 40, v).reshape(min(len(x), len(y)), -1).sum(1) for v in (x, y))
    return int(np.minimum(x, y).sum())


def bounded(pairs: DataFrame, plan: Near) -> DataFrame:
    """The pairs (a, b) that bins_a and bins_b don't exclude; n_a and n_b are the numbers of shingles."""

    def run(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            most = np.fromiter(map(most_common, batch.column("bins_a").to_pylist(), batch.column("bins_b").to_pylist()), np.int64, len(n))
            yield batch.select(["a", "b"]).filter(pa.array(most >= plan.similarity * (n - most) - 1e-9))

    return pairs.mapInArrow(run, "a long, b long")


def sketched(docs: DataFrame, plan: Near, keep: list[str]) -> DataFrame:
    """fp (equal for texts with equal words), n (distinct shingles), print (SimHash), bins and prefix of each text."""
    often = docs.sparkSession.sparkContext.broadcast(common(docs, plan))

    def make(own, seen):
        h = shingles(own, plan, seen)
        return _key(own), len(h), print_of(h), bins(h), prefix(h, often.value, plan).view(np.int64)

    return _run(docs, [("fp", T.LongType()), ("n", T.IntegerType()), ("print", T.LongType()), ("bins", T.BinaryType()), ("prefix", T.ArrayType(T.LongType()))], make, keep)


def ball_pairs(own: DataFrame, plan: Near) -> DataFrame:
    """Pairs (a, b) of texts with equal or neighbouring SimHash fingerprints; a fingerprint's texts meet its least one."""
    from brindle.llm.simhash import ball_links

    some = own.where("n > 0")
    heads = cut(some.groupBy("print").agg(F.min("fp").alias("head")))
    head = lambda x: heads.select(F.col("print").alias(x), F.col("head").alias(f"head_{x}"))
    near = ball_links(heads.select(F.col("print").alias("fp"))).join(head("a"), "a").join(head("b"), "b").select("head_a", "head_b")
    same = some.join(heads, "print").where("fp <> head").select("fp", "head")
    return near.union(same).toDF("a", "b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def keyed_rows(marked: DataFrame, plan: Near) -> DataFrame:
    """(fp, n, key, pos): the prefixes' shingles that several different texts have in theirs."""
    every = marked.where("n > 0").select("fp", "n", F.posexplode("prefix").alias("pos", "key")).repartition("key")
    own = F.struct("fp", "n", "pos")  # all columns, so that both sides of the join read one exchange
    several = every.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low.fp <> high.fp").select("key")
    return every.join(several, "key").select("fp", "n", "key", "pos").distinct()


def possible(plan: Near, a: str, b: str) -> Column:
    """Whether sizes and positions of a shared shingle allow near copies, if none is shared before it."""
    n_a, n_b, t = F.col(f"n{a}"), F.col(f"n{b}"), plan.similarity
    left = F.least(n_a - F.col(f"pos{a}"), n_b - F.col(f"pos{b}"))
    return (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * F.lit(t) - 1e-6) & (left >= (n_a + n_b) * F.lit(t / (1 + t)) - 1e-6)


def chosen(keyed: DataFrame, plan: Near) -> DataFrame:
    """A pair (a, b) for each text that may have near copies: of the texts that share its most frequent shingle, with that
    which has fewest shingles before it, so least of its own."""
    hub = F.min(F.struct("pos", F.xxhash64("key", "fp").alias("h"), F.col("fp").alias("hub"), F.col("n").alias("n_hub"))).alias("x")
    hubs = keyed.groupBy("key").agg(F.count("*").alias("m"), hub).select("key", "m", "x.hub", "x.n_hub", F.col("x.pos").alias("pos_hub"))
    met = keyed.join(hubs, "key").where((F.col("fp") != F.col("hub")) & possible(plan, "", "_hub"))
    best = met.groupBy("fp").agg(F.max_by("hub", F.struct("m", "key")).alias("hub"))
    return best.select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b"))


def across(keyed: DataFrame, root: DataFrame, plan: Near) -> DataFrame:
    """All pairs (a, b) of different components that share a shingle of their prefixes and may be near copies."""
    mixed = cut(_mixed(_rooted(keyed, root, "fp"), plan))
    side = lambda x: mixed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "pos", "root_fp")])
    met = side("a").join(side("b"), "key").where((F.col("fp_a") > F.col("fp_b")) & (F.col("root_fp_a") != F.col("root_fp_b")) & possible(plan, "_a", "_b"))
    return met.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def _rooted(df: DataFrame, root: DataFrame, fp: str) -> DataFrame:
    """df with root_<fp>: the component of its column fp, itself if it has no link."""
    at = root.select(F.col("node").alias(fp), F.col("root").alias(f"root_{fp}"))
    return df.join(at, fp, "left").withColumn(f"root_{fp}", F.coalesce(f"root_{fp}", fp))


def _mixed(keyed: DataFrame, plan: Near) -> DataFrame:
    """Rows of keyed whose key is found in more than one component; the others have nothing left to link."""
    several = keyed.groupBy("key").agg(F.min("root_fp").alias("low"), F.max("root_fp").alias("high")).where("low <> high")
    return keyed.join(several.select("key"), "key", "left_semi")


def _similar(plan: Near) -> Column:
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return common >= plan.similarity * (F.size("hashes_a") + F.size("hashes_b") - common) - 1e-9


def near_links(docs: DataFrame, marked: DataFrame, row: Column, plan: Near) -> DataFrame:
    """Links (a, b) that join the near copies of docs. marked has doc_id, __row (row, a hash of a document's row), fp, n,
    print, bins and prefix of each document."""
    own = marked.groupBy("fp").agg(F.first("n").alias("n"), F.first("print").alias("print"))
    keyed = cut(keyed_rows(marked, plan))
    repeated = not marked.groupBy("__row").count().where("count > 1").isEmpty()

    def few(df: DataFrame) -> DataFrame:
        """df, to be broadcast if its count allows."""
        return F.broadcast(df) if df.count() <= plan.broadcast_rows else df

    def asked(p: DataFrame, *values: str) -> DataFrame:
        """fp and the values of one row of each text in the pairs p."""
        fps = few(cut(p.select(F.col("a").alias("fp")).union(p.select("b")).distinct()))
        one = marked.select("fp", *values).join(fps, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(*values)).alias("one"))
        return cut(one.select("fp", "one.*"))

    def likely(p: DataFrame) -> DataFrame:
        """The pairs p that bins don't exclude."""
        known = asked(p, "n", "bins")
        side = lambda x: known.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
        return cut(bounded(p.select("a", "b").join(side("a"), "a").join(side("b"), "b"), plan))

    def hashed(p: DataFrame) -> DataFrame:
        """The shingle hashes of the texts in the pairs p. Texts are shuffled only if rows repeat or too many are asked for."""
        one = few(asked(p, "__row").select(F.col("__row").alias("__met")).distinct())
        texts = docs.select("text", row.alias("__row")).join(one, F.col("__row") == F.col("__met"), "left_semi").select("text")
        texts = texts.dropDuplicates() if repeated else texts
        make = lambda own, seen: (_key(own), shingles(own, plan, seen).view(np.int64))
        return cut(_run(texts, [("fp", T.LongType()), ("hashes", T.ArrayType(T.LongType()))], make, []))

    def verified(p: DataFrame) -> DataFrame:
        p = likely(p)
        sets = hashed(p)
        side = lambda x: sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"hashes_{x}"))
        return cut(p.join(side("a"), "a").join(side("b"), "b").where(_similar(plan)).select("a", "b").distinct())

    links = verified(cut(ball_pairs(own, plan).union(chosen(keyed, plan)).distinct()))
    pairs = cut(across(keyed, components(links), plan))
    return links if pairs.isEmpty() else links.union(verified(pairs))
