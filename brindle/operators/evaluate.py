"""Retrieval metrics and their rollups, and answer leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, first_rank, hit5, hit10, rr for each query of gold (query_id, doc_id), with or without results."""
    met = gold.join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    hit = lambda n: F.when(F.col("first_rank") <= n, 1.0).otherwise(0.0)
    return met.select("query_id", "first_rank", hit(5).alias("hit5"), hit(10).alias("hit10"), F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def rollup(metrics: DataFrame, kind: str, digits: int = 4) -> DataFrame:
    """Means by kind (null: unknown) and over all."""
    mean = lambda c: F.round(F.avg(c), digits).alias(c)
    named = metrics.withColumn("kind", F.coalesce(F.col(kind), F.lit("unknown")))
    rows = named.rollup("kind").agg(F.count("*").alias("n"), mean("hit5"), mean("hit10"), mean("rr"), F.grouping("kind").alias("g"))
    return rows.withColumn("kind", F.when(F.col("g") == 1, "ALL").otherwise(F.col("kind"))).drop("g")


def recovered(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Queries that method base misses in its first ten and method other finds."""
    hits = metrics.groupBy("query_id").pivot("method", [base, other]).agg(F.first("hit10"))
    return hits.where((F.coalesce(F.col(f"`{base}`"), F.lit(0.0)) == 0) & (F.col(f"`{other}`") == 1)).select("query_id")


def leaderboard(scores: DataFrame, parts: list[str]) -> DataFrame:
    """Of scores (packet_id, condition, model, best, and the parts): means by model, by condition, and wins."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    means = [F.round(F.avg(p), 2).alias(p) for p in parts]
    return scores.withColumn("total", total).groupBy("model").agg(F.count("*").alias("n"), *means, F.round(F.avg("total"), 2).alias("total"), F.sum(F.when(F.col("best"), 1).otherwise(0)).alias("wins"))


def packets(questions: DataFrame, answers: DataFrame, letters: dict[str, str]) -> DataFrame:
    """A row for each question and condition that all models have answered, with a column for each letter. letters:
    model by letter; answers: qid, condition, model, answer."""
    wide = answers.groupBy("qid", "condition").pivot("model", list(letters.values())).agg(F.first("answer"))
    full = wide.where(sum((F.when(F.col(f"`{m}`").isNull(), 1).otherwise(0) for m in letters.values()), F.lit(0)) == 0)
    return full.join(questions, "qid").select("qid", "condition", "question", *[F.col(f"`{m}`").alias(x) for x, m in letters.items()])


def deanonymised(judged: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scores by model from judged (packet_id, condition, scores map, best) and mapping (packet_id, letter, model)."""
    each = judged.select("packet_id", "condition", "best", F.explode("scores").alias("letter", "score"))
    return each.join(mapping, ["packet_id", "letter"]).select("packet_id", "condition", "model", "score", (F.col("best") == F.col("letter")).alias("best"))


def pass_stats(rows: DataFrame, score: str, thresholds: tuple[float, ...] = (0.70, 0.85)) -> DataFrame:
    """Mean, median and pass rates of parsed scores, and how many couldn't be parsed."""
    rates = [F.round(F.count_if(F.col(score) >= t) / F.greatest(F.count(score), F.lit(1)), 4).alias(f"pass_{round(100 * t)}") for t in thresholds]
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.median(score), 6).alias("median"), *rates, F.count_if(F.col(score).isNull()).alias("unparsed"))


def exact_match(rows: DataFrame, expected: Column, answer: Column) -> DataFrame:
    hit = F.contains(F.lower(F.trim(answer)), F.lower(F.trim(expected)))
    return rows.agg(F.round(F.count_if(hit) / F.greatest(F.count("*"), F.lit(1)), 6).alias("exact_match"))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """min, the upper of the two middle values, and max, by a ranked join rather than a collected list."""
    at = F.row_number().over(Window.orderBy(column))  # over distinct values
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy(column))
    total = F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = counts.select(column, running.alias("upto"), total.alias("total"), at.alias("at"))
    return found.agg(F.min(column).alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(column))).alias("median"), F.max(column).alias("most"))
