"""Hashed-word features of whole texts, bounded training samples, and linear scores, for the classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import kernel

BITS = 18
SIZE = 1 << BITS
_TRIM = ".,;:!?\"'()[]{}<>|#*$%&"
_SYMBOLS = frozenset("#*$%&|<>~^=+_@\\")
#: Dense features beside the words, see dense().
DENSE = 9


def buckets(distinct: pa.Array) -> np.ndarray:
    """The hash bucket of each distinct word, in lower case and without punctuation around it."""
    trimmed = pc.ascii_trim(pc.utf8_lower(distinct), characters=_TRIM).to_pylist()
    return np.array([zlib.crc32(w.encode()) for w in trimmed], np.int64) & (SIZE - 1)


def endings(distinct: pa.Array) -> np.ndarray:
    """A bucket for the symbol at each distinct word's end, -1 if there is none."""
    last = [w[-1:] for w in distinct.to_pylist()]
    return np.array([zlib.crc32(("\0" + c).encode()) & (SIZE - 1) if c in _SYMBOLS else -1 for c in last], np.int64)


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of words and of symbols at their ends, each pair once, sorted, for a filled array of texts."""
    flat, starts = kernel.words(texts)
    ids, distinct = kernel.coded(flat)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    end = endings(distinct)[ids]
    pairs = np.unique(np.concatenate([text << BITS | buckets(distinct)[ids], (text << BITS | end)[end >= 0]]))
    return pairs >> BITS, pairs & (SIZE - 1)


def dense(texts: pa.Array) -> np.ndarray:
    """A row for each text, about 0 to 1: length, shares of symbols, repeated lines, windows and words, capitals,
    exclamation marks, word length, and shortness."""
    c = {k: v.astype(np.float64) for k, v in kernel.text_counts(texts).items()}
    n = np.maximum(c["n_words"], 1)
    share = lambda k: np.minimum(c[k] / n, 1)
    short = np.maximum(0, 1 - c["n_words"] / 20)
    return np.stack([np.log1p(c["n_words"]) / 10, np.sqrt(share("n_symbols")), np.sqrt(share("n_dup_lines")), np.sqrt(share("n_repeat_words")), np.minimum(c["word_chars"] / n / 12, 2), short, np.sqrt(share("n_adjacent")), np.minimum(c["n_capitals"] / np.maximum(c["word_chars"], 1), 1), np.sqrt(share("n_calls"))], 1)


def sample(ids: DataFrame, most: int) -> DataFrame:
    """At most so many rows of ids (doc_id, ...), those with the smallest hash of doc_id: the documented bound of a
    classifier's training. The choice doesn't depend on how rows lie in partitions."""
    n = ids.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = ids.withColumn("h", place)
    if n > most:  # few more rows than wanted are sorted and sent, from however many partitions
        rows = rows.where(F.col("h") <= int((1 << 40) * min(1.0, (most + 8 * most**0.5 + 20) / n)))
    return rows.orderBy("h", *ids.columns).limit(most).drop("h")


def training_rows(docs: DataFrame, chosen: DataFrame, with_dense: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the chosen documents (doc_id, y), whose number sample() has bounded: y, (text, bucket) pairs, dense.

    Features of whole texts are worked out on the executors; the driver gets a text's distinct buckets.
    """

    def run(batches):
        for batch in batches:
            for piece in kernel.pieces(batch):
                texts = kernel.filled(piece.column("text"))
                text, bucket = word_pairs(texts)
                ends = np.searchsorted(text, np.arange(piece.num_rows + 1)).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
                more = dense(texts) if with_dense else np.zeros((piece.num_rows, DENSE))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("y"), rows, pa.array(list(more), pa.list_(pa.float64()))], names=["doc_id", "y", "rows", "more"])

    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").cast("double").alias("y"))
    got = own.mapInArrow(run, "doc_id long, y double, rows array<int>, more array<double>").orderBy("doc_id", "y").toArrow()
    rows = got["rows"].combine_chunks()
    n = np.diff(np.asarray(rows.offsets))
    y = got["y"].to_numpy()
    more = np.array(got["more"].to_pylist(), np.float64).reshape(len(y), DENSE)
    return y, np.repeat(np.arange(len(y)), n), rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), more


def telling(inside: np.ndarray, outside: np.ndarray, n_inside: int, n_outside: int, errors: float) -> np.ndarray:
    """Buckets whose share of documents differs between two samples by so many standard errors."""
    both = (inside + outside) / (n_inside + n_outside)
    error = np.sqrt(both * (1 - both) * (1 / max(n_inside, 1) + 1 / max(n_outside, 1))) + 1e-12
    return np.abs(inside / max(n_inside, 1) - outside / max(n_outside, 1)) >= errors * error


class Adam:
    """Steps against a gradient."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def linear_scores(docs: DataFrame, weights: np.ndarray, dense_weights: np.ndarray | None, finish: Callable[[np.ndarray], dict[str, np.ndarray]], more: list[T.StructField], carry: list[str]) -> DataFrame:
    """carry columns of docs and what finish makes of each text's sum of weights. weights go along (SIZE floats)."""
    box = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), dense_weights))
    kept = [f for f in docs.schema.fields if f.name in carry]

    def run(batches):
        w, d = box.value
        for batch in batches:
            for piece in kernel.pieces(batch):
                texts = kernel.filled(piece.column("text"))
                text, bucket = word_pairs(texts)
                sums = np.bincount(text, w[bucket], piece.num_rows)
                if d is not None:
                    sums = sums + dense(texts) @ d
                found = finish(sums)
                yield pa.RecordBatch.from_arrays([piece.column(f.name) for f in kept] + [pa.array(found[f.name]) for f in more], names=[f.name for f in [*kept, *more]])

    return docs.mapInArrow(run, T.StructType([*kept, *more]))
