"""Sharding by histogram sort, with DataFrame functions only.

Documents are sorted by a hash of their text and, within it, of their id. The splitters between shards are found
without sorting: every round counts the exact bytes below evenly spaced probes over all partitions, keeps for each
splitter the probes around its share of the bytes, and probes between these anew, until a probe meets the share within
the tolerance or no key lies between two probes. Then the rows are exchanged once, by shard and cell.

Equal texts have equal hashes, and a splitter between hashes leaves them in one shard; only a group of copies that
is larger than the tolerance allows is split, by the hash of the id. Slots number the rows of a shard without gaps
through counts of cells: a cell holds about as many rows as there are cells, and a hot cell is divided by the id's hash.

Defined results: a null text has size 1 (no bytes, plus 1) and the crc32 of no bytes; rows that repeat both id and
text stay together; very long texts count whole; an empty table gives an empty table; further columns are carried along
by sharded(), but for those with the names of its own; set_aside() renames these first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, fresh, table

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Shards:
    shards: int = 8
    #: A splitter may miss its share of the bytes by so much of a shard.
    tolerance: float = 0.002
    #: Each round narrows a splitter's interval by so many bits.
    bits: int = 10


def keys(text: Column, doc_id: Column) -> tuple[Column, Column, Column]:
    """The two parts of the sort key, and the size: bytes plus 1."""
    return F.xxhash64(text), F.xxhash64(doc_id), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _refine(rows: DataFrame, key: str, wanted: list[float], below: int, slack: float, bits: int) -> list[tuple[int, int, bool]]:
    """For each wanted number of bytes: (probe, bytes below it, met). Rows at or above the probe are not below it.

    below: bytes that come before all of rows. A round is one aggregation of the rows that lie in an open interval;
    what comes to the driver is a row for each probe that has rows, at most 2**bits for each splitter.
    """
    spans = {j: (_LOW, 64, below) for j in range(len(wanted))}  # start, width in bits, bytes below
    found: dict[int, tuple[int, int, bool]] = {}
    while spans:
        open_ = sorted(set(spans.values()))
        span, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (start, width, _) in enumerate(open_):
            inside = F.lit(True) if width == 64 else F.col(key).between(start, start + (1 << width) - 1)
            step = max(0, width - bits)
            at = (F.shiftright(key, step) - (start >> step)).cast("long")
            span, cell = F.when(inside, F.lit(i)).otherwise(span), F.when(inside, at).otherwise(cell)
        counts = rows.select(span.alias("span"), cell.alias("cell"), "size", F.col(key).alias("key")).where("span is not null")
        cells = counts.groupBy("span", "cell").agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")).orderBy("span", "cell").collect()
        was, spans = spans, {}
        for j, own in was.items():
            start, width, sum_ = own
            step, i = max(0, width - bits), open_.index(own)
            hit = None
            for c in cells:
                if c["span"] != i:
                    continue
                if sum_ + c["size"] >= wanted[j]:
                    hit = c
                    break
                sum_ += c["size"]
            if hit is None:  # all of these rows lie below
                found[j] = (_HIGH, sum_, True)
                continue
            before, after = (hit["first"], sum_), (hit["last"] + 1, sum_ + hit["size"])
            near = min((before, after), key=lambda p: abs(p[1] - wanted[j]))
            if abs(near[1] - wanted[j]) <= slack or hit["first"] == hit["last"] or step == 0:
                met = abs(near[1] - wanted[j]) <= slack
                found[j] = (*near, True) if met else (*before, False)
            else:
                spans[j] = (((start >> step) + hit["cell"]) << step, step, sum_)
    return [found[j] for j in range(len(wanted))]


def splitters(rows: DataFrame, plan: Shards) -> list[tuple[int, int]]:
    """Sort keys (k1, k2) at which shards 1, 2, ... begin, from rows (k1, k2, size)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / plan.shards
    wanted = [share * j for j in range(1, plan.shards)]
    slack = share * plan.tolerance
    out: list[tuple[int, int] | None] = [None] * len(wanted)
    groups: dict[int, list[int]] = {}
    first = _refine(rows, "k1", wanted, 0, slack, plan.bits)
    for j, (probe, _, met) in enumerate(first):
        if met:
            out[j] = (probe, _LOW)
        else:
            groups.setdefault(probe, []).append(j)
    for probe, js in groups.items():  # one text's copies are more than the tolerance: their ids decide
        own = rows.where(F.col("k1") == F.lit(probe))
        found = _refine(own, "k2", [wanted[j] for j in js], first[js[0]][1], slack, plan.bits)
        ends = {p: b for p, b, _ in found}
        size = own.agg(F.sum("size")).first()[0]
        for j, (p, below, met) in zip(js, found, strict=True):
            if not met:  # the row at the probe: whichever edge is nearer
                row = own.where(F.col("k2") == F.lit(p)).agg(F.sum("size")).first()[0]
                p, below = min(((p, ends[p]), (p + 1, ends[p] + row)), key=lambda e: abs(e[1] - wanted[j]))
            whole = min(((probe, first[j][1]), (probe + 1, first[j][1] + size)), key=lambda e: abs(e[1] - wanted[j]))
            out[j] = (whole[0], _LOW) if abs(whole[1] - wanted[j]) <= abs(below - wanted[j]) + slack else (probe, p)
    return sorted(out)


def sharded(docs: DataFrame, plan: Shards | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (columns of docs with such names go); docs have
    doc_id and text. drop: columns that needn't go through the exchange."""
    plan = plan or Shards()
    k1, k2, size = keys(F.col("text"), F.col("doc_id"))
    narrow = cut(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")))
    starts = splitters(narrow, plan)
    n = narrow.count()
    bits = max(3, min(20, (max(n, 1).bit_length() + 1) // 2))
    names = {c: fresh([*docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"], f"__{c}") for c in ("k1", "k2", "cell", "sub", "deep", "rank", "offset")}

    def shard(a: str, b: str) -> Column:
        return sum((F.when((F.col(a) > s) | ((F.col(a) == s) & (F.col(b) >= t)), 1).otherwise(0) for s, t in starts), F.lit(0)).cast("int")

    # Cells with many times the mean of rows are divided by k2. There are fewer than 2**bits / 8 of them.
    cell = lambda a: F.shiftright(a, 64 - bits)
    hot = narrow.groupBy(cell("k1").alias(names["cell"])).agg(F.count("*").alias("n")).where(F.col("n") > max(64, 8 * (n >> bits)))
    hot = cut(hot.select(names["cell"], F.ceil(F.log2(F.col("n") / max(16, n >> bits))).cast("int").alias(names["deep"])))
    deep = F.coalesce(F.col(names["deep"]), F.lit(0))
    sub = F.when(deep == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright({names['k2']}, cast(64 - {names['deep']} as int))"))
    place = ["shard", names["cell"], names["sub"]]

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn(names["cell"], cell(names["k1"])).withColumn("shard", shard(names["k1"], names["k2"]))
        return df.join(F.broadcast(hot), names["cell"], "left").withColumn(names["sub"], sub).drop(names["deep"])

    counts = placed(narrow.select(F.col("k1").alias(names["k1"]), F.col("k2").alias(names["k2"]))).groupBy(place).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("shard").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = counts.select(*place, below.alias(names["offset"]))
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c.lower() not in new]
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size.alias("size"), crc.alias("text_crc32"), k1.alias(names["k1"]), k2.alias(names["k2"])).drop(*drop)
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(names["k1"], names["k2"], "doc_id"))
    out = placed(rows).join(offsets, place).withColumn("slot", (F.col(names["offset"]) + rank - 1).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in kept if c not in drop], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def set_aside(docs: DataFrame) -> DataFrame:
    """docs, with columns that have a name of sharded()'s own under a fresh one (size becomes size_)."""
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    taken = [*new, *docs.columns]
    names = []
    for c in docs.columns:
        names.append(fresh(taken, c) if c.lower() in new else c)
        taken.append(names[-1])
    return docs.toDF(*names)


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
