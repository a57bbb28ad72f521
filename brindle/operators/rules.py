"""A rule scan over a log table: simple findings in one pass, paired ones by a greedy walk in time.

A rule is a dict (as YAML gives it): name, severity, category, patterns (each with msg_code or regex), and maybe
correlation {type: paired, max_window_minutes}. Codes of simple patterns are prefixes, those of pairs must be equal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.search import prefix

#: Order of findings.
RANKS = ("critical", "warning", "info")


def load_rules(text: str, platform: str | None = None) -> list[dict]:
    """Rules of a YAML text; a text for another platform has none."""
    import yaml

    spec = yaml.safe_load(text) or {}
    if platform is not None and spec.get("platform") not in (None, platform):
        return []
    return [{"severity": "info", "category": "", "patterns": [], **r} for r in spec.get("rules", [])]


def _matches(pattern: dict, messages: tuple[str, ...], exact: bool = False) -> Column:
    if pattern.get("msg_code"):
        return F.col("msg_code") == pattern["msg_code"] if exact else prefix("msg_code", pattern["msg_code"])
    return reduce(lambda a, b: a | b, [F.col(m).rlike(f"(?i){pattern['regex']}") for m in messages])


def is_paired(rule: dict) -> bool:
    return (rule.get("correlation") or {}).get("type") == "paired" and len(rule["patterns"]) >= 2


def simple_findings(logs: DataFrame, rules: list[dict], samples: int = 5) -> DataFrame:
    """A row for each rule with hits: hits (a row that meets two patterns counts twice), first and last time, and the
    first rows as samples. Patterns are conditions of one scan; a row carries the rules that it meets, so rules are
    never joined with logs."""
    hits = [F.when(F.coalesce(_matches(p, ("message", "raw_line")), F.lit(False)), F.struct(F.lit(r["name"]).alias("rule"), F.lit(k).alias("pattern"))) for r in rules if not is_paired(r) for k, p in enumerate(r["patterns"])]
    if not hits:
        hits = [F.lit(None).cast("struct<rule:string,pattern:int>")]
    met = logs.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).withColumn("rule", F.col("hit.rule"))
    found = met.groupBy("rule").agg(F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    rank = F.row_number().over(Window.partitionBy("rule", "part").orderBy("ts", "id", "hit.pattern"))
    few = met.withColumn("part", F.pmod(F.hash("id"), F.lit(64))).withColumn("rank", rank).where(F.col("rank") <= samples)
    few = few.groupBy("rule").agg(F.slice(F.sort_array(F.collect_list(F.struct("ts", "id", F.col("hit.pattern").alias("pattern"), "message"))), 1, samples).alias("samples"))
    return found.join(few, "rule")


def greedy_pairs(first: np.ndarray, second: np.ndarray, window: float, first_ids=None, second_ids=None) -> list[tuple[int, int]]:
    """One-to-one pairs of two rising series, nearer than window, by a walk that always lets go of the earlier one."""
    out, i, j = [], 0, 0
    while i < len(first) and j < len(second):
        if first_ids is not None and first_ids[i] == second_ids[j]:
            j += 1
        elif abs(second[j] - first[i]) < window:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif first[i] <= second[j]:
            i += 1
        else:
            j += 1
    return out


def paired_counts(logs: DataFrame, first: Column, second: Column, window_s: float, by: list[str]) -> DataFrame:
    """pairs for each group of by: the greedy walk is a state machine over time, so it runs on the group's rows, of
    which only the time, the side and the id are sent. Split groups by a key that pairs must share (host, user)."""
    sides = logs.select(*by, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "id", F.coalesce(first, F.lit(False)).alias("a"), F.coalesce(second, F.lit(False)).alias("b")).where("a or b")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        a, b = pdf[pdf["a"]], pdf[pdf["b"]]
        pairs = greedy_pairs(a["us"].to_numpy(), b["us"].to_numpy(), window_s * 1e6, a["id"].to_numpy(), b["id"].to_numpy())
        return pd.DataFrame([[*key, len(pairs), len(a), len(b)]], columns=[*by, "pairs", "n_first", "n_second"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in sides.schema.fields if f.name in by]
    return sides.groupBy(*by).applyInPandas(run, ", ".join([*kinds, "pairs long", "n_first long", "n_second long"]))


def pair_candidates(logs: DataFrame, first: Column, second: Column, window_s: int, by: list[str]) -> DataFrame:
    """All pairs nearer than the window, by time bins: each row of one side meets the other's in its bin and the two
    beside it. A superset of greedy pairs."""
    us, width = F.unix_micros(F.col("ts").cast("timestamp")), window_s * 1_000_000
    base = logs.withColumn("us", us).withColumn("bin", F.floor(us / width))
    a = base.where(first).select(*by, F.col("id").alias("first_id"), F.col("us").alias("first_us"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    b = base.where(second).select(*by, F.col("id").alias("second_id"), F.col("us").alias("second_us"), "bin")
    return a.join(b, [*by, "bin"]).where(F.abs(F.col("first_us") - F.col("second_us")) < width).drop("bin", "first_us", "second_us")


def paired_finding(logs: DataFrame, rule: dict, by: list[str]) -> DataFrame:
    """The paired rule's finding: pairs over all groups, and the time span of both sides' rows, paired or not."""
    p, window = rule["patterns"], 60 * (rule.get("correlation") or {}).get("max_window_minutes", 30)
    first, second = (_matches(x, ("message",), exact=True) for x in p[:2])
    pairs = paired_counts(logs, first, second, window, by).agg(F.sum("pairs").alias("hits"))
    span = logs.where(F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False))).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return pairs.crossJoin(span).where("hits > 0").select(F.lit(rule["name"]).alias("rule"), "hits", "first_seen", "last_seen")


def ordered(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings with severity and category, critical first, then by hits."""
    about = findings.sparkSession.createDataFrame([(r["name"], r["severity"], r["category"], i) for i, r in enumerate(rules)], "rule string, severity string, category string, place int")
    rank = F.when(F.col("severity") == RANKS[0], 0).when(F.col("severity") == RANKS[1], 1).when(F.col("severity") == RANKS[2], 2).otherwise(9)
    return findings.join(F.broadcast(about), "rule").orderBy(rank, F.desc("hits"), "place").drop("place")
