"""Structured Streaming forms of log ingest: counts by window and severity, and de-duplication in a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.logs import parse_line


def log_stream(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Rows of log lines in files that come under path; lines that no grammar knows go."""
    lines = spark.readStream.text(path).select(parse_line(F.col("value"), now).alias("e"))
    return lines.where("e is not null").select("e.*").withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need one


def counts(logs: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    return logs.withWatermark("ts", watermark).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n")).select("window.start", "severity", "n")


def first_seen(rows: DataFrame, key: list[str], at: str = "ts", ttl: str = "1 day") -> DataFrame:
    return rows.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)
