"""Counters of replicated records collapsed by key, top lists, and orders that read numbers in names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_int(value: Column) -> Column:
    """The value as bigint; 0 if it is none."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def collapse(records: DataFrame, key: str, counters: list[str], others: list[str], position: str) -> DataFrame:
    """A row for each key: counters summed, other columns from the first record, in order of first sight. Records
    without a key go."""
    aggs = [F.sum(safe_int(F.col(f"`{c}`"))).alias(c) for c in counters] + [F.min_by(F.col(f"`{o}`"), F.col(position)).alias(o) for o in others]
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs, F.min(position).alias("first_position")).orderBy("first_position")


def collapse_fields(records: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """As collapse() for records (category, fields map<string,string>, pos) whose columns aren't known beforehand."""
    own = F.col("fields").getItem(key)
    sums = [F.sum(safe_int(F.col("fields").getItem(c))).alias(c) for c in counters]
    return records.withColumn("key", own).where("key is not null").groupBy("category", "key").agg(*sums, F.min_by("fields", "pos").alias("first_fields"), F.min("pos").alias("first_position"))


def resource_summary(records: DataFrame, category: str, key: str) -> DataFrame:
    """Distinct keys of each category."""
    return records.groupBy(category).agg(F.countDistinct(key).alias("resources"))


def busiest(records: DataFrame, counter: str, n: int, position: str) -> DataFrame:
    return records.orderBy(F.desc(safe_int(F.col(counter))), position).limit(n)


def soonest(records: DataFrame, expiry: str, n: int, position: str) -> DataFrame:
    """Records by rising expiry in epoch seconds; those that can't be read come last."""
    return records.orderBy(F.coalesce(F.col(expiry).try_cast("bigint"), F.lit((1 << 63) - 1)), position).limit(n)


def partitioned_name(column: str) -> Column:
    """The name if it is a full path, else null."""
    return F.when(F.trim(F.col(column)).startswith("/"), F.trim(F.col(column)))


def with_errors(records: DataFrame, counters: list[str]) -> DataFrame:
    return records.where(F.greatest(*[safe_int(F.col(f"`{c}`")) for c in counters]) > 0)


def not_bundled(records: DataFrame, name: str) -> DataFrame:
    """Without certificates that are numbered members of a bundle."""
    return records.where(~F.col(name).rlike(r"\.crt\.\d+$"))


def natural_order(column: str) -> list[Column]:
    """Names like 1.10 by their numbers, then mgmt, then others, empty ones last."""
    c = F.col(column)
    numeric, number = c.rlike(r"^\d+(\.\d+)*$"), lambda i: F.try_element_at(F.split(c, r"\."), F.lit(i)).try_cast("int")
    kind = F.when(numeric, 0).when(F.lower(c) == "mgmt", 1).when(F.coalesce(F.trim(c), F.lit("")) != "", 2).otherwise(3)
    return [kind, number(1), number(2), number(3), c]


def coverage(paths: DataFrame) -> DataFrame:
    """Of parsed snapshot paths (family, blade, type, interval): how many, and what kinds, intervals by number."""
    kinds = [F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(f"{c}s") for c in ("family", "blade", "type")]
    intervals = F.transform(F.array_sort(F.collect_set(F.col("interval").try_cast("int"))), lambda x: x.cast("string"))
    return paths.agg(F.count("*").alias("n"), *kinds, intervals.alias("intervals"))
