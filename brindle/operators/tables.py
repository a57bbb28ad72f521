"""Keyed tables as snapshots: upserts, retention, staleness, resumption and reuse. Every function returns the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.lineage import cut


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(current: DataFrame, incoming: DataFrame, key: str, now: Column, skip_equal: str | None = None) -> DataFrame:
    """current with incoming rows merged by key, and an outcome column: inserted, updated, unchanged or kept.

    Both have the same columns, with created_at and last_fetched (filled here). Of incoming rows with one key the last
    wins (by its place column _pos, if there). skip_equal: a hash column whose equality leaves the row as it is.
    """
    if "_pos" in incoming.columns:
        incoming = latest(incoming, [key], [F.col("_pos")]).drop("_pos")
    names = [c for c in current.columns if c not in (key, "created_at", "last_fetched")]
    a, b = current.alias("a"), incoming.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    new, old = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    same = (F.col(f"a.{skip_equal}") == F.col(f"b.{skip_equal}")) if skip_equal else F.lit(False)
    take = new & ~(old & F.coalesce(same, F.lit(False)))
    outcome = F.when(take & old, "updated").when(take, "inserted").when(new, "unchanged").otherwise("kept")
    cols = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)] + [F.when(take, F.col(f"b.{n}")).otherwise(F.col(f"a.{n}")).alias(n) for n in names]
    return joined.select(*cols, F.coalesce("a.created_at", now).alias("created_at"), F.when(take, now).otherwise(F.col("a.last_fetched")).alias("last_fetched"), outcome.alias("outcome"))


def upsert_by_url(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each incoming row (url, doc_id): updated if its url is known, error if its doc_id is taken by another
    url, else inserted."""
    known = current.select(F.col("url").alias("_url")).distinct()
    taken = current.select(F.col("doc_id").alias("_doc")).distinct()
    rows = incoming.join(known, incoming["url"] == F.col("_url"), "left").join(taken, incoming["doc_id"] == F.col("_doc"), "left")
    return rows.withColumn("outcome", F.when(F.col("_url").isNotNull(), "updated").when(F.col("_doc").isNotNull(), "error").otherwise("inserted")).drop("_url", "_doc")


def retained(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def orphans(files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Files whose row is gone."""
    return files.join(rows.select(key), key, "left_anti")


def stale(ids: DataFrame, state: DataFrame, key: str, at: str, now: Column, ttl_days: float) -> DataFrame:
    """ids that are missing in state or strictly older than the time to live."""
    rows = ids.join(state.select(key, F.col(at).alias("_at")), key, "left")
    return rows.where(F.col("_at").isNull() | (F.col("_at") < now - F.make_interval(days=F.lit(int(ttl_days))))).drop("_at")


def to_fetch(urls: DataFrame, log: DataFrame, now: Column, ttl_days: float, force: bool = False) -> DataFrame:
    """urls never fetched, or at least ttl_days ago. log: url, fetched_ts in epoch seconds, the latest counts."""
    seen = log.groupBy("url").agg(F.max("fetched_ts").alias("_ts"))
    rows = urls.join(seen, "url", "left")
    due = F.lit(force) | F.col("_ts").isNull() | ((now.cast("double") - F.col("_ts")) / 86400 >= ttl_days)
    return rows.where(due).drop("_ts")


def touched(current: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """last_fetched set to now for ids that exist."""
    hit = ids.select(F.col(key).alias("_k")).distinct()
    return current.join(hit, current[key] == F.col("_k"), "left").withColumn("last_fetched", F.when(F.col("_k").isNotNull(), now).otherwise(F.col("last_fetched"))).drop("_k")


def reuse_vectors(docs: DataFrame, index: DataFrame) -> DataFrame:
    """docs (doc_id, hash, n_chunks) with whether the index's vectors (doc_id, hash, n_chunks) can stay."""
    old = index.groupBy("doc_id").agg(F.max("hash").alias("_hash"), F.max("n_chunks").alias("_n"))
    same = (F.col("hash") == F.col("_hash")) & (F.col("n_chunks") == F.col("_n"))
    return docs.join(old, "doc_id", "left").withColumn("reuse", F.coalesce(same, F.lit(False))).drop("_hash", "_n")


def unanswered(tasks: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    return tasks.join(answers.select(*key), key, "left_anti")


def outcomes(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def crawl(pages: DataFrame, seeds: DataFrame, depth: int, allowed: Column | None = None) -> DataFrame:
    """(url, depth) reached from seeds (url) over pages (url, links): each url once, at its least depth. A frontier of
    one depth at a time is joined with the pages; pages that aren't there (not fetched) end the way."""
    links = pages.select("url", F.explode("links").alias("to"))
    links = links.where(allowed) if allowed is not None else links
    found = reach(links.select(F.col("url").alias("a"), F.col("to").alias("b")), seeds.select(F.col("url").alias("node")), depth)
    return found.select(F.col("node").alias("url"), F.col("steps").alias("depth"))


def reach(edges: DataFrame, start: DataFrame, most: int = 50) -> DataFrame:
    """(node, steps) reached over edges (a, b) from start (node) in at most so many steps, each node at its least.
    A step joins the last frontier with the edges and leaves out what was seen; it is cut, so that a level's plan
    doesn't hold the earlier ones. Ends when nothing new is found."""
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    frontier = cut(start.select("node").where(F.col("node").isNotNull()).distinct().withColumn("steps", F.lit(0)))
    seen = frontier
    for steps in range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(steps)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def sessions(rows: DataFrame, key: str, at: str, order: str, gap_s: int) -> DataFrame:
    """rows with a session number: a new one after a gap of more than gap_s seconds."""
    w = Window.partitionBy(key).orderBy(at, order)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(us - F.lag(us).over(w) > gap_s * 1_000_000, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")
