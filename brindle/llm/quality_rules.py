"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

Every document is tried against plain rules. The failures are counted by host (documents carry it as source; a null
source is a host of its own). A host's failure rate is shrunk towards the mean of all hosts by a beta prior whose
strength is taken from the hosts themselves by the method of moments, so that a host with few documents isn't judged by
chance. A host is then trusted, watched or rejected, and the verdict goes back to its documents: from a rejected host
none is kept, from a watched one only those that break no rule, and from a trusted one those that break none by more
than the slack.

Defined results: null or empty texts have no words and fail; repeated rows are judged one by one, each counting for
its host; very long texts are counted whole, alone in a slice; an empty table gives an empty table; further columns are
carried along by judge() and don't disturb, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import kernel
from brindle.llm.common import cut, fresh, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRules:
    """min_words and max_repeat (percent of words in repeated windows) are the base rules, which reject by themselves.

    The others count as failures: max_symbols (percent of words), max_dup_lines (percent of words), and the mean
    length of words. watch and reject bound a host's shrunk failure rate.
    """

    min_words: int = 20
    max_repeat: int = 30
    max_symbols: int = 10
    max_dup_lines: int = 10
    mean_chars: tuple[float, float] = (2.5, 12.0)
    watch: float = 0.4
    reject: float = 0.7
    #: Limits of the rules beside the base rules are so many times wider for documents of trusted hosts.
    slack: float = 2.0
    #: The strength of the prior, in documents, stays in this range.
    strength: tuple[float, float] = (2.0, 10_000.0)
    #: Host verdicts are broadcast only up to so many hosts (names cut by no one: see by_host), else joined by shuffle.
    broadcast_hosts: int = 50_000

    def base_failed(self, c: dict[str, Column]) -> Column:
        return (c["n_words"] < self.min_words) | (100 * c["n_repeat_words"] > self.max_repeat * c["n_words"])

    def failed(self, c: dict[str, Column], slack: float = 1.0) -> Column:
        n = c["n_words"] * F.lit(slack)
        lengths = (c["word_chars"] * slack < self.mean_chars[0] * c["n_words"]) | (c["word_chars"] > self.mean_chars[1] * n)
        return self.base_failed(c) | (100 * c["n_symbols"] > self.max_symbols * n) | (100 * c["n_dup_lines"] > self.max_dup_lines * n) | lengths


def counted(docs: DataFrame, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with the counts of each text; also the columns' names by count. Arrow batches, whole texts."""
    names = {c: fresh(docs.columns, f"__{c}") for c in COUNTS}
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches):
        for batch in batches:
            for piece in kernel.pieces(batch, limit=1 << 20):
                found = kernel.text_counts(kernel.filled(piece.column("text")))
                columns = [piece.column(f.name) for f in kept] + [pa.array(found[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [names[c] for c in COUNTS])

    return docs.mapInArrow(run, T.StructType(kept + [T.StructField(names[c], T.LongType()) for c in COUNTS])), names


def host_verdicts(counted_docs: DataFrame, names: dict[str, str], rules: HostRules) -> DataFrame:
    """(host, rate, verdict) of each host; one row for each, from partial sums over its documents."""
    c = {k: F.col(v) for k, v in names.items()}
    hosts = cut(counted_docs.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"), F.sum(rules.failed(c).cast("long")).alias("k")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts"), F.sum(F.col("k") / F.col("n") * F.col("k")).alias("kk")).first()
    n, k = total["n"] or 0, total["k"] or 0
    mean = (k + 0.5) / (n + 1)
    # Between hosts: the weighted variance of the rates, less what binomial draws of that size show anyway.
    between = (total["kk"] or 0) / n - (k / n) ** 2 - mean * (1 - mean) * total["hosts"] / n if n else 0.0
    most = mean * (1 - mean) / between - 1 if between > 0 else rules.strength[1]
    strength = min(max(most, rules.strength[0]), rules.strength[1])
    rate = (F.col("k") + mean * strength) / (F.col("n") + strength)
    verdict = F.when(rate > rules.reject, "rejected").when(rate > rules.watch, "watched").otherwise("trusted")
    return hosts.select("host", rate.alias("rate"), verdict.alias("verdict"))


def judge(docs: DataFrame, hosts: DataFrame, names: dict[str, str], rules: HostRules) -> tuple[DataFrame, str, str]:
    """docs (with counts) and the columns base_failed and kept; returns their names too.

    Only hosts that aren't trusted are joined. They are broadcast if their number and the length of their names are
    within bounds; otherwise an equi-join on the host is left to Spark, which splits a hot host's side.
    """
    base, kept, host, verdict = (fresh(docs.columns, x) for x in ("__base_failed", "__kept", "__host", "__verdict"))
    odd = cut(hosts.where("verdict <> 'trusted'").select(F.col("host").alias(host), F.col("verdict").alias(verdict)))
    n, longest = odd.agg(F.count("*"), F.max(F.octet_length(host))).first()
    c = {k: F.col(v) for k, v in names.items()}
    if n:
        small = n <= rules.broadcast_hosts and (longest or 0) <= 255
        docs = docs.join(F.broadcast(odd) if small else odd, docs["source"].eqNullSafe(odd[host]), "left").drop(host)
    else:
        docs = docs.withColumn(verdict, F.lit(None).cast("string"))
    docs = docs.withColumn(base, rules.base_failed(c))
    ok = F.when(F.col(verdict) == "rejected", False).when(F.col(verdict) == "watched", ~rules.failed(c)).otherwise(~rules.failed(c, rules.slack))
    return docs.withColumn(kept, ~F.col(base) & ok), base, kept


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = HostRules()
    docs, names = counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    docs = cut(docs)
    found, base, kept = judge(docs, host_verdicts(docs, names, rules), names, rules)
    return found.select("doc_id", *[F.col(names[c]).alias(c) for c in COUNTS], F.col(base).alias("base_failed"), F.col(kept).alias("kept"))


def keep_good(docs: DataFrame, rules: HostRules | None = None) -> DataFrame:
    """The documents that are kept, with their own columns: counts for the hosts first, then a second pass that filters."""
    rules = rules or HostRules()
    narrow, names = counted(docs.select("source", "text"), keep_text=False)
    hosts = host_verdicts(narrow, names, rules)
    full, names = counted(docs)
    found, _, kept = judge(full, hosts, names, rules)
    return found.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS first_word, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7])) AS own FROM w WHERE len(w) >= 8),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(first_word, first_word + 8)) AS pos FROM (SELECT r, first_word, count(*) OVER (PARTITION BY r, own) AS n FROM win) WHERE n > 1) GROUP BY 1),
c AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 10 * n_words OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words AS strict,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 20 * n_words OR 2 * word_chars < 2.5 * n_words OR word_chars > 24 * n_words AS loose FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(strict)::DOUBLE AS k FROM f GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS hosts, sum(k / n * k) AS kk, (sum(k) + 0.5) / (sum(n) + 1) AS mean FROM h),
b AS (SELECT mean, kk / n - (k / n) * (k / n) - mean * (1 - mean) * hosts / n AS between_hosts FROM t),
s AS (SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1 ELSE 10000.0 END, 2.0), 10000.0) AS strength FROM b),
v AS (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND CASE WHEN rate > 0.7 THEN false WHEN rate > 0.4 THEN NOT strict ELSE NOT loose END AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
