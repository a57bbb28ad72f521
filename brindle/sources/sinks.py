"""Sinks: JSON lines, raw payloads, reports, packages and vector tables."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.lineage import cut

#: What becomes of an earlier result.
MODES = {"overwrite": "overwrite", "skip": "ignore", "fail": "errorifexists"}


def write_json_lines(df: DataFrame, path: str, existing: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(MODES[existing])
    (writer.partitionBy(*by) if by else writer).json(path)


def payloads(pages: DataFrame) -> DataFrame:
    """Raw pages with the name of the file that holds each: the url's SHA-1."""
    return pages.withColumn("file", F.concat(F.sha1("url"), F.lit(".json")))


def write_failures(rows: DataFrame, good: str, bad: str) -> None:
    """rows with a reason go to bad, the others to good."""
    write_json_lines(rows.where("reason is null").drop("reason"), good)
    write_json_lines(rows.where("reason is not null"), bad)


def trimmed(entries: DataFrame, most: int = 300, width: int = 2048) -> DataFrame:
    """Entries for a client: without message, long raw lines cut with a mark."""
    raw = F.when(F.length("raw_line") > width, F.concat(F.substring("raw_line", 1, width), F.lit("…[truncated]"))).otherwise(F.col("raw_line"))
    return entries.orderBy("ts", "id").limit(most).withColumn("raw_line", raw).drop("message")


def report(**parts: DataFrame) -> DataFrame:
    """One row with a JSON text of all parts, each a list of its rows: findings, summaries and the like, which are
    results of bounded size."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*parts)).alias("report"))


def review_blocks(rows: DataFrame, tag: str, line: Column) -> DataFrame:
    """A markdown block for each tag."""
    return rows.groupBy(tag).agg(F.concat(F.lit("## "), F.first(tag), F.lit("\n\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("block"))


def package(path: str, files: dict[str, bytes], summary: dict) -> None:
    """A zip of small files and a summary, on the driver."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
        z.writestr("summary.json", json.dumps(summary, ensure_ascii=False))


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").partitionBy("source").parquet(path)


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with a batch number, size rows each, in order; the last may be smaller. Rows are numbered in ranges of the
    order, whose counts are added up first; order should tell all rows apart."""
    ranged = cut(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("batch", F.floor(at / size)).drop("_part", "_before")
