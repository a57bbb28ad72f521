"""Filtered, paged and faceted search over a log table, and its summaries.

A log table has id, ts (timestamp_ntz), hostname, severity, severity_num, process, msg_code, message, source_file and
raw_line. All conditions are column expressions, so they reach the scan; every order ends in id, so pages are stable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity names in order of their numbers (syslog).
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")


def severity_number(name: Column, default: int = 6) -> Column:
    """0 for emerg to 7 for debug; unknown names get the default."""
    found = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(name))
    return F.when(found > 0, found - 1).otherwise(default).cast("int")


def prefix(column: str, value: str) -> Column:
    """Begins with value, whatever the case of ASCII letters; % and _ in value are plain characters."""
    return F.lower(F.col(column)).startswith(value.lower())


def search_terms(text: str) -> list[str]:
    """Words of a search text of two characters or more; all of them must be found."""
    import re

    return [w for w in re.sub(r"\W", " ", text)[:512].lower().split() if len(w) >= 2]


def has_all(column: str, terms: list[str], tokens: str = r"[^\p{L}\p{N}_]+") -> Column:
    """Every term is a word of the column."""
    words = F.split(F.lower(F.col(column)), tokens)
    return reduce(lambda a, b: a & b, [F.array_contains(words, t) for t in terms], F.lit(True))


def filtered(logs: DataFrame, start=None, end=None, max_severity=None, severity=None, process=None, msg_code=None, source_file=None, search=None) -> DataFrame:
    """Rows that meet all conditions that are given; start and end are included."""
    conditions = []
    if start is not None:
        conditions.append(F.col("ts") >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        conditions.append(F.col("ts") <= F.to_timestamp_ntz(F.lit(end)))
    if max_severity is not None:
        conditions.append(F.col("severity_num") <= max_severity)
    if severity is not None:
        conditions.append(F.col("severity") == severity)
    if process is not None:
        conditions.append(F.col("process") == process)
    if msg_code is not None:
        conditions.append(prefix("msg_code", msg_code))
    if source_file is not None:
        conditions.append(prefix("source_file", source_file))
    if search is not None:
        conditions.append(has_all("message", search_terms(search)))
    return reduce(lambda df, c: df.where(c), conditions, logs)


def page(logs: DataFrame, limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
    limit, offset = min(max(limit, 1), 500), max(offset, 0)
    order = [F.desc("ts"), F.desc("id")] if descending else [F.asc("ts"), F.asc("id")]
    return logs.orderBy(*order).offset(offset).limit(limit)


def search_page(logs: DataFrame, limit: int, offset: int = 0, **conditions) -> DataFrame:
    """A page with the number of all hits and whether there are more after it."""
    hits = filtered(logs, **conditions)
    total = hits.agg(F.count("*").alias("total"))
    shown = page(hits, limit, offset)
    return shown.crossJoin(F.broadcast(total)).withColumn("capped", F.col("total") > offset + min(max(limit, 1), 500))


def facets(logs: DataFrame, limit: int = 100) -> DataFrame:
    """(facet, value, n) by severity, process and source in one pass; the last two at most limit values each."""
    sets = logs.groupingSets([["severity"], ["process"], ["source_file"]], "severity", "process", "source_file")
    n = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "process").otherwise("source")
    value = F.when(F.col("g") == 3, F.col("severity")).when(F.col("g") == 5, F.col("process")).otherwise(F.col("source_file"))
    rows = n.select(facet.alias("facet"), value.alias("value"), "n")
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("value")))
    return rows.withColumn("rank", rank).where((F.col("facet") == "severity") | (F.col("rank") <= limit)).drop("rank")


def severity_summary(logs: DataFrame) -> DataFrame:
    return logs.groupBy("severity").agg(F.count("*").alias("n"), F.min("severity_num").alias("severity_num")).orderBy("severity_num", "severity")


def count_by(logs: DataFrame, column: str) -> DataFrame:
    return logs.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def time_range(logs: DataFrame) -> DataFrame:
    return logs.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def top_codes(logs: DataFrame, limit: int) -> DataFrame:
    """The most frequent message codes, each with the message of its first row."""
    known = logs.where("msg_code is not null").groupBy("msg_code").agg(F.count("*").alias("n"), F.min_by("message", "id").alias("sample"))
    return known.orderBy(F.desc("n"), "msg_code").limit(limit)


def newest(logs: DataFrame, cap: int) -> DataFrame:
    """The newest cap rows in rising order, and a note if there are more."""
    total = logs.agg(F.count("*").alias("total"))
    kept = logs.orderBy(F.desc("ts"), F.desc("id")).limit(cap).crossJoin(F.broadcast(total))
    note = F.when(F.col("total") > cap, F.format_string("newest %d of %d rows", F.lit(cap), F.col("total")))
    return kept.withColumn("note", note).drop("total").orderBy("ts", "id")


def common_host(logs: DataFrame) -> DataFrame:
    """The most frequent host name that says something; of equally frequent ones that seen first."""
    named = logs.where(F.trim("hostname") != "").where(~F.col("hostname").isin("-", "localhost"))
    return named.groupBy("hostname").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(1)
