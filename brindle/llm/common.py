"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators mean it, as a character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which is also where checkpoints go. Only where driver and executors
    are one process (tests) is a folder made if none is named."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp("brindle"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names.

    See shared_folder().
    Only narrow tables are cut: a checkpoint holds plain rows, and Spark removes it when nothing refers to it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name near base that none of columns has (names clash without regard to case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def by_text(df: DataFrame) -> list[Column]:
    """Keys by which equal documents (same id and text) meet, for joins of decisions that depend on these alone."""
    return [F.xxhash64("text"), F.length("text")]


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b) bigint pairs in any order. Returns (node, root), root being the component's smallest node, for
    nodes that have an edge to another node. Each step is a partial aggregation and an equi-join, so a hub's edges are
    combined before the shuffle and its side of the join can be split; no component is ever gathered in a task.
    The number of rounds grows with the logarithm of the longest path. Every round is cut by a checkpoint, whose
    partitions are as few as the counted edges allow.
    """
    few = lambda df: df.coalesce(8 + mark[0] // 50_000)
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = few(now)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(few(small.where("a <> b").distinct()))
        if (was := mark) == (mark := _mark(now)):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number, and sums of two hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())
