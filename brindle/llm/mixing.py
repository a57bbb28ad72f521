"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources share a budget of words by weight. A source whose share passes its size times the maximum of epochs is clamped
there, and the excess goes to the others by weight, until no share is above its cap. A source's target is then taken
in seeded order: as many whole repetitions of every document as fit, and a further, fractional one that runs through
the documents in the order of a seeded digest of id and text until the target's words are reached; the last of them
gives part of its words.

Where the fractional repetition of a source ends is found on narrow rows: sums of buckets of the digest's order, about
as many as the square root of the source's documents, then the one bucket in which the words run out, with equal rows
summed up first. No window holds a whole source. What comes of it is a row for each source, so that documents get their
decision where they are read, without a shuffle.

Defined results: null texts have size 0 and are taken 0 times (or stay as they are when rows are repeated); a null
source is a source of its own, last in order; null or repeated ids are told apart by their texts; of rows that repeat
both id and text each is taken alike, and if the words run out among them each gives an equal part; very long texts
count whole; an empty table gives an empty table; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, cut, fresh, table


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in order of their names by code point, null last, repeating.
    weights: tuple[float, ...] = (5, 2, 1)
    #: The budget, as a share of all words.
    share: float = 1.5
    max_epochs: float = 2.0
    seed: str = "mix-1"
    #: The sources' plan (some 150 bytes each beside the name) is broadcast up to so many, else joined by shuffle.
    broadcast_sources: int = 50_000


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    n = F.size(F.split(text, f"[{SPACE}]+")) - F.when(text.rlike(f"\\A[{SPACE}]"), 1).otherwise(0) - F.when(text.rlike(f"[{SPACE}]\\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(n, F.lit(0))).cast("long")


def seeded(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of a digest of seed, id and text, by which a source's documents are in order."""
    whole = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _numbered(df: DataFrame, order: list[Column], parts: int, sums: dict[str, Column]) -> DataFrame:
    """df (cut) with running sums, each up to and with its row, in an order over all rows: ranges of the order are summed
    up by themselves, then their totals, which are a row for each of the parts."""
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()])
    totals = totals.select("part", *[F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_before") for k in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.join(F.broadcast(totals), "part")
    return ranged.select(*df.columns, *[(F.col(f"{k}_before") + F.sum(c).over(own)).alias(k) for k, c in sums.items()])


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """sources (source, source_size, n): adds place (order), weight, cap and target. One row for each source.

    In the order in which sources reach their caps, by cap over weight, prefix sums tell the level to which the others
    can rise when those before are clamped; it is right at the first source that it doesn't fill.
    """
    order = [F.col("source").isNull(), F.col("source")]
    n, words = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    parts, total = max(1, min(200, n // 5000)), words * mix.share
    placed = _numbered(sources, order, parts, {"place": F.lit(1)}).withColumn("place", F.col("place") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("place") % len(mix.weights) + 1).cast("int"))
    caps = cut(placed.select("source", "source_size", "n", "place", weight.alias("weight"), (F.col("source_size") * F.lit(mix.max_epochs)).alias("cap")))
    weights = caps.agg(F.sum("weight")).first()[0] or 0.0
    filled = _numbered(caps, [F.col("cap") / F.col("weight"), *order], parts, {"caps": F.col("cap"), "weights": F.col("weight")})
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (F.lit(weights) - F.col("weights") + F.col("weight"))
    level = filled.select(level.alias("level"), (F.col("cap") / F.col("weight")).alias("full")).where("level <= full").agg(F.min_by("level", "full")).first()[0]
    return caps.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)) if level is not None else F.col("cap"))


_KEY = ("digest", "size", "doc_id")


def plans(narrow: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source of narrow (cut; doc_id, source, size, digest): source_size, target, whole (repetitions), and
    of the fractional one the last rows' key (last), how many rows share it (m) and the words they give together (give);
    key and give are null if it takes all documents or none (then partly is true or false)."""
    sources = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    plan = targets(sources, mix)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    plan = cut(plan.withColumn("whole", whole).withColumn("rest", rest).withColumn("buckets", F.ceil(F.sqrt("n"))).select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", "buckets"))
    small = plan.count() <= mix.broadcast_sources
    bucket = F.floor(F.col("digest") * (F.col("buckets") / F.lit(float(1 << 60)))).cast("long")
    dealt = narrow.join(_hint(plan.select("of", "buckets", "rest"), small), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket)
    sums = dealt.groupBy("of", "rest", "bucket").agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("done", up_to).where("done - words < rest AND rest <= done").select(F.col("of").alias("at"), F.col("bucket").alias("end"), (F.col("rest") - F.col("done") + F.col("words")).alias("left"))
    ends = cut(ends)
    rows = dealt.join(_hint(ends, small), F.col("source").eqNullSafe(F.col("at")) & (F.col("bucket") == F.col("end"))).groupBy("at", "left", *_KEY).agg(F.count("*").alias("m"))
    words = F.col("m") * F.col("size")
    done = F.sum(words).over(Window.partitionBy("at").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.withColumn("done", done).where(F.col("done") - words < F.col("left")).where(F.col("left") <= F.col("done"))
    last = last.select("at", F.struct(*_KEY).alias("last"), "m", (F.col("left") - F.col("done") + words).alias("give"))
    plan = plan.join(last, F.col("of").eqNullSafe(F.col("at")), "left").drop("at", "buckets")
    return cut(plan.withColumn("partly", F.col("rest") > 0).drop("rest"))


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def taken(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with source_size, target and taken; docs have doc_id, source, size, digest (of seeded()), and columns to
    carry along. The plan of the sources is broadcast only if they are few enough."""
    narrow = cut(docs.select("doc_id", "source", "size", "digest"))
    docs = narrow if set(docs.columns) == set(narrow.columns) else docs
    plan = plans(narrow, mix)
    joined = docs.join(_hint(plan, plan.count() <= mix.broadcast_sources), F.col("source").eqNullSafe(F.col("of")))
    key, size = F.struct(*_KEY), F.col("size")
    part = F.when(~F.col("partly"), 0).when(F.col("last").isNull() | (key < F.col("last")), size).when(key == F.col("last"), F.floor(F.col("give") / F.col("m"))).otherwise(0)
    # null ids are equal to each other here: in structs, nulls are ordered as the least value
    part = F.when(F.col("partly") & F.col("doc_id").isNull() & F.col("last.doc_id").isNull() & (F.col("last.digest") == F.col("digest")) & (F.col("last.size") == size), F.floor(F.col("give") / F.col("m"))).otherwise(part)
    return joined.withColumn("taken", (F.col("whole") * size + part).cast("long")).drop("of", "last", "m", "give", "partly", "digest")


def op7_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), F.col("text"), mix.seed).alias("digest"))
    return taken(docs, mix).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
         ('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:15])::BIGINT AS digest
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS place FROM s),
w AS (SELECT *, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM p),
o AS (SELECT *, cap / weight AS full_at, (SELECT sum(source_size) * 1.5::DOUBLE FROM s) AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
             sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT arg_min((budget - capped) / open, full_at) FILTER ((budget - capped) / open <= full_at) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM o, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, source_size, target, whole, round(target)::BIGINT - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS done
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - done)))::BIGINT AS taken FROM r
"""


def mixed_rows(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents of the mix, with their own columns: whole repetitions as repeated rows, and a fractional one as a
    row with the words that were taken, joined by blanks (n_chars, if there, is its length). Null and wordless texts
    are no part of a mix."""
    mix = mix or Mix()
    names = {c: fresh(docs.columns, f"own_{i}") for i, c in enumerate(docs.columns)}
    row = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), F.col("text"), mix.seed).alias("digest"), F.struct(*[F.col(f"`{c}`").alias(names[c]) for c in docs.columns]).alias("row"))
    found = taken(row, mix).where("taken > 0")
    spread = found.withColumn("words", F.explode(F.expr("transform(sequence(0, cast((taken - 1) div size as int)), i -> least(size, taken - i * size))")))
    partial = F.col("words") < F.col("size")
    own_words = F.filter(F.split(f"row.{names['text']}", f"[{SPACE}]+"), lambda x: x != "")
    text = F.when(partial, F.array_join(F.slice(own_words, 1, F.col("words").cast("int")), " ")).otherwise(F.col(f"row.{names['text']}"))
    own = [text.alias(c) if c == "text" else F.col(f"row.{names[c]}").alias(c) for c in docs.columns]
    out = spread.select(*own)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
