"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation in numpy.

Vocabulary. Words are counted over the whole training fold. The most frequent words, and the end of a text, are output
classes of their own; every other word is in one of a fixed number of classes by its form (last letter, letters beyond
ASCII, closing punctuation), and its probability is that of its class times its share in the class by counts. So each
token has a probability, and all of them sum to one, however large the vocabulary is.

Model. The representation predicted for the next word is the sum of the three preceding words' vectors, each times
its position's matrix; its product with an output's vector plus a bias is the output's score. Every output word has a
context vector of its own too, and the number of these words grows with the corpus (as the root of its distinct words);
rarer words are seen as contexts by their form. Training is stochastic NCE over all training tokens: each task runs
through its share from the same start, and the tasks' parameters are averaged by tokens, in two rounds (a short first
one, then all texts).

Normalisation. Outputs stand in groups of consecutive ranks, as large as there are groups. An output's probability is
its group's among all groups (which have vectors of their own, trained by NCE on the same representation) times its own
within the group; both are exactly normalised softmaxes, worked out by matrix products for a batch of tokens.

Scoring. Frequent words' counts go along with the model (their number and length are bounded, as longer words are known
by a digest); the others are joined to the counts by an equi-join, from rows that hold a word once for each text. A word
that is hot is among the frequent ones, whatever its length, and isn't shuffled.

Defined results: null and empty texts have one token, the end; repeated rows are scored one by one and count as often
in training; very long texts are scored whole, one at a time; an empty table gives an empty table; if no text is in the
training fold, all counts are 0; further columns don't disturb.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import kernel
from brindle.llm.common import cut, fold_of, table

#: Forms: last byte (a-z, other), or the letter before a closing punctuation mark, each with and without bytes over 127.
FORMS = 112
_SMALL = 13


@dataclass(frozen=True)
class LogBilinear:
    classes: int = 4096  # frequent words that are classes of their own
    known: int = 200_000  # frequent words at most whose counts go along with the model
    contexts: int = 4096  # frequent words that are context symbols of their own
    growth: int = 2  # classes and contexts are at least so many times the root of the number of distinct words
    group: int = 128  # outputs in a group, at least
    dims: int = 16
    noise: int = 64
    batch: int = 2048
    rate: float = 0.15
    seed: int = 7
    group_noise: int = 16
    #: The first round takes one in so many texts of the training fold, by hash; the second takes all.
    first_round: int = 16


def forms(words: pa.Array) -> np.ndarray:
    """The form of each word (a large_string array of non-empty words), by its bytes."""
    offsets, data = kernel.raw(words)
    last = data[offsets[1:] - 1].astype(np.int64)
    before = np.where(np.diff(offsets) > 1, data[np.maximum(offsets[1:] - 2, 0)], 0).astype(np.int64)
    letter = lambda x: (x >= 97) & (x <= 122)
    sums = np.concatenate([[0], np.cumsum(data >= 128)])
    wide = (sums[offsets[1:]] - sums[offsets[:-1]]) > 0
    form = np.where(letter(last), last - 97, np.where(last >= 128, 53, np.where((last >= 48) & (last <= 57), 54, 55)))
    form = np.where(np.isin(last, list(b".,;:!?\"')")), np.where(letter(before), 26 + before - 97, 52), form)
    return form + 56 * wide


def _small_forms(form: np.ndarray) -> np.ndarray:
    """The form as a context symbol: kind of ending and wide letters."""
    base, wide = form % 56, form // 56
    letter = np.where(base < 26, base, np.where(base < 52, base - 26, -1))
    kind = np.where(letter < 0, 4, np.where(np.isin(letter, [0, 4, 8, 14, 20]), 0, 2) + ((base >= 26) & (base < 52)))
    return kind + 5 * wide


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(kernel.filled(texts))


#: Words of more bytes are known by their digest.
LONG_WORD = 64


def keyed(distinct: pa.Array) -> pa.Array:
    """Distinct words, of which long ones are replaced by a blank and their digest: as words have no blanks, these are
    equal to no other word."""
    distinct = pa.concat_arrays([distinct.cast(pa.large_string())])
    long = pc.greater(pc.binary_length(distinct), LONG_WORD)
    if not pc.any(long).as_py():
        return distinct
    digests = [" " + hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=24).hexdigest() for w in distinct.filter(long).to_pylist()]
    return pc.replace_with_mask(distinct, long, pa.array(digests, pa.large_string()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs; each batch sends a word once."""

    def run(batches):
        for batch in batches:
            for piece in kernel.pieces(batch, limit=3 << 20):
                flat, _ = kernel.words(lowered(piece.column(0)))
                v = pc.value_counts(flat)
                yield pa.RecordBatch.from_arrays([keyed(v.field("values")).cast(pa.string()), v.field("counts").cast(pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words in order of their counts (ties by word), and what each word is to the model."""

    def __init__(self, words: list[str], counts: np.ndarray, ends: int, plan: LogBilinear):
        self.plan, self.counts, self.ends = plan, counts.astype(np.float64), ends
        self.frame = pa.array(words, pa.large_string())
        self.own = min(plan.classes, len(words))  # outputs: these, the end, the forms
        self.end, self.outputs = self.own, self.own + 1 + FORMS
        form = forms(self.frame) if words else np.zeros(0, np.int64)
        rank = np.arange(len(words))
        self.output = np.where(rank < self.own, rank, self.own + 1 + form)
        self.symbol = np.where(rank < plan.contexts, rank, plan.contexts + 1 + _small_forms(form))
        self.symbols = plan.contexts + 1 + _SMALL

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: the place among the frequent ones or -1, the output class, the context symbol."""
        place = pc.fill_null(pc.index_in(distinct, value_set=self.frame), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.frame) else np.full(len(distinct), -1)
        form = forms(distinct) if len(distinct) else np.zeros(0, np.int64)
        known = place >= 0
        at = np.maximum(place, 0)
        output = np.where(known, self.output[at] if len(self.output) else 0, self.own + 1 + form)
        symbol = np.where(known, self.symbol[at] if len(self.symbol) else 0, self.plan.contexts + 1 + _small_forms(form))
        return place, output, symbol

    def tokens(self, texts: pa.Array):
        """Of lower-cased texts, with an end after each: output classes, the three preceding symbols, and for words the
        distinct words' numbers, the distinct words and their places; starts counts tokens."""
        flat, starts = kernel.words(texts)
        ids, distinct = kernel.coded(flat)
        distinct = keyed(distinct)
        place, output, symbol = self.look_up(distinct)
        n = len(texts)
        ends = starts[1:] + np.arange(n)
        y, s = np.full(len(ids) + n, self.end), np.full(len(ids) + n, self.plan.contexts)
        is_word = np.ones(len(y), bool)
        is_word[ends] = False
        y[is_word], s[is_word] = output[ids], symbol[ids]
        begins = starts + np.arange(n + 1)
        since = np.arange(len(y)) - np.repeat(begins[:-1], np.diff(begins))
        before = np.stack([np.where(since >= j, np.concatenate([np.full(j, self.plan.contexts), s[:-j]])[: len(s)], self.plan.contexts) for j in (1, 2, 3)])
        return y, before, ids, distinct, place, starts, begins


class Model:
    """Parameters: R (symbols), C (a matrix for each position), Q and b (outputs), G and g (groups of outputs)."""

    NAMES = ("R", "C", "Q", "b", "G", "g")

    def __init__(self, vocabulary: Vocabulary, share: np.ndarray):
        plan, rng = vocabulary.plan, np.random.default_rng(vocabulary.plan.seed)
        self.share = share
        self.R = rng.normal(0, 0.3, (vocabulary.symbols, plan.dims)).astype(np.float32)
        self.C = np.stack([np.eye(plan.dims)] * 3).astype(np.float32) / 2
        self.Q = rng.normal(0, 0.1, (vocabulary.outputs, plan.dims)).astype(np.float32)
        self.b = np.log(share).astype(np.float32)
        self.size = max(plan.group, math.isqrt(max(0, len(share) - 1)) + 1)
        self.group_share = np.add.reduceat(share, np.arange(0, len(share), self.size))
        self.G = rng.normal(0, 0.1, (len(self.group_share), plan.dims)).astype(np.float32)
        self.g = np.log(self.group_share).astype(np.float32)

    def get(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def set(self, flat: np.ndarray) -> Model:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def trainer(self, plan: LogBilinear, seed: int):
        """A function that takes classes and contexts and makes NCE steps with Adagrad."""
        rng = np.random.default_rng(seed)
        past = {k: np.full_like(getattr(self, k), START[k]) for k in self.NAMES}

        def squash(x, times=np.float32(1)):
            """times / (1 + exp(-x)), in the place of x."""
            np.exp(np.minimum(np.negative(x, out=x), 80, out=x), out=x)
            x += 1
            return np.divide(times, x, out=x)

        def ascend(name, grad, rows=slice(None)):
            past[name][rows] += grad * grad
            getattr(self, name)[rows] += plan.rate * grad / np.sqrt(past[name][rows])

        def contrast(vectors, biases, share, draws):
            """The NCE step of one set of outputs: takes targets and representations, gives the latter's gradient."""
            ladder, log_kq = np.cumsum(share), np.log(draws * share).astype(np.float32)
            # each distinct noise class stands for its expected number among the noise draws
            times = (draws * share / -np.expm1(draws * np.log1p(-np.minimum(share, 0.999999)))).astype(np.float32)

            def one(y, r):
                Q, b, n = getattr(self, vectors), getattr(self, biases), len(y)
                noise = np.unique(np.minimum(np.searchsorted(ladder, rng.random(draws) * ladder[-1]), len(share) - 1))
                q = Q[y]
                up = 1 - squash(np.einsum("ij,ij->i", r, q) + (b - log_kq)[y])
                down = r @ Q[noise].T
                down += (b - log_kq)[noise]
                down = squash(down, -times[noise])
                dr = up[:, None] * q
                dr += down @ Q[noise]
                keys, order, starts = runs(np.concatenate([y, noise]))
                ascend(vectors, np.add.reduceat(np.concatenate([up[:, None] * r, down.T @ r])[order], starts, axis=0) / n, keys)
                ascend(biases, np.add.reduceat(np.concatenate([up, down.sum(0)])[order], starts) / n, keys)
                return dr

            return one

        words, groups = contrast("Q", "b", self.share, plan.noise), contrast("G", "g", self.group_share, plan.group_noise)

        def step(y, before):
            vectors = [self.R[c] for c in before]
            r = sum(v @ c for v, c in zip(vectors, self.C, strict=True))
            dr = words(y, r)
            if len(self.G) > 1:
                dr += groups(y // self.size, r)
            keys, order, starts = runs(before.ravel())
            dR = np.add.reduceat(np.concatenate([dr @ c.T for c in self.C])[order], starts, axis=0)
            dC = np.stack([v.T @ dr for v in vectors])
            ascend("R", dR / len(y), keys)
            ascend("C", dC / len(y))

        return step

    def positions(self) -> np.ndarray:
        """Vectors of each position's symbols."""
        return np.stack([self.R @ c for c in self.C])

    def log_probability(self, r: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of outputs y after representations r."""
        of = y // self.size
        p = _softmax_at(r @ self.G.T + self.g, of) if len(self.G) > 1 else np.zeros(len(y), np.float32)
        order = np.argsort(of.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(self.G) + 1))
        r, at = r[order], y[order] - of[order] * self.size
        own = np.empty(len(y), np.float32)
        for k in range(len(self.G)):
            s, o = slice(cuts[k], cuts[k + 1]), slice(k * self.size, (k + 1) * self.size)
            if s.start < s.stop:
                own[s] = _softmax_at(r[s] @ self.Q[o].T + self.b[o], at[s])
        p[order] += own
        return p.astype(np.float64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a model with a single group and few symbols: vectors of each position's symbols, and log normalisers of
        all contexts."""
        t = self.positions()
        z = np.empty((len(self.R),) * 3, np.float32)
        for i in range(len(self.R)):
            s = (t[0][i] + t[1][:, None] + t[2][None]) @ self.Q.T + self.b
            top = s.max(2)
            z[i] = top + np.log(np.exp(s - top[..., None]).sum(2))
        return t, z


#: Where Adagrad's sums of squares begin.
START = {"R": 1e-6, "C": 1.0, "Q": 1e-4, "b": 1e-2, "G": 1e-4, "g": 1e-2}


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the order that puts equal keys together, and where each one's run starts."""
    small = keys.astype(np.uint16 if keys.max() < 1 << 16 else np.uint32)  # the former are sorted by digits
    order = np.argsort(small, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], order, starts


def _softmax_at(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one entry of each row of scores, which are overwritten."""
    picked = s[np.arange(len(s)), at]
    top = s.max(1)
    s -= top[:, None]
    np.exp(s, out=s)
    return picked - top - np.log(s.sum(1))


#: So many tasks' parameters at most are averaged in one place.
FAN_IN = 32


def averaged(frame: DataFrame) -> DataFrame:
    """The weighted mean of parameters (part, weight, params), one row or none: level by level, groups of FAN_IN parts
    become one."""
    frame = cut(frame)
    while (frame.agg(F.max("part")).first()[0] or 0) > 0:
        frame = cut(_average(frame.withColumn("group", F.floor(F.col("part") / FAN_IN)), "group").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")))
    return frame


def _average(frame: DataFrame, key: str) -> DataFrame:
    """Means of parameters (bytes of float32) by weight, for each value of key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, weight = 0.0, 0.0
        for w, p in zip(pdf["weight"], pdf["params"], strict=True):
            total, weight = total + w * np.frombuffer(p, np.float32), weight + w
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "weight": [weight], "params": [(total / weight).astype(np.float32).tobytes()]})

    return frame.groupBy(key).applyInPandas(run, "part long, weight double, params binary")


def train(docs: DataFrame, vocabulary: Vocabulary, share: np.ndarray) -> Model:
    """Two rounds of local NCE over docs (text) and averaging; the driver gets one mean a round."""
    plan, model = vocabulary.plan, Model(vocabulary, share)
    for first in (True, False):
        own = docs.where(F.pmod(F.xxhash64("text"), F.lit(plan.first_round)) == 0) if first else docs
        start = model.get()

        def run(batches, start=start, first=first):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            local = Model(vocabulary, share).set(start)
            step, n = local.trainer(plan, plan.seed + 2 * part + first), 0
            for batch in batches:
                for piece in kernel.pieces(batch, limit=1 << 20):
                    y, before, *_ = vocabulary.tokens(lowered(piece.column(0)))
                    for at in range(0, len(y), plan.batch):
                        step(y[at : at + plan.batch], before[:, at : at + plan.batch])
                    n += len(y)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(n)]), pa.array([local.get().astype(np.float32).tobytes()], pa.binary())], names=["part", "weight", "params"])

        means = own.select("text").mapInArrow(run, "part long, weight double, params binary")
        means = averaged(means).collect()
        if means:
            weights = np.array([m["weight"] for m in means])
            model.set(sum(w * np.frombuffer(m["params"], np.float32) for w, m in zip(weights / weights.sum(), means, strict=True)))
    return model


def frequent(counts: DataFrame, plan: LogBilinear) -> pd.DataFrame:
    """The plan.known most frequent words, by falling count, ties by word: all of the steps of a logarithmic scale of
    counts that fit, and the first of the next step. No more rows than that come to the driver, from however many
    partitions."""
    stepped = counts.withColumn("step", F.floor(F.log2("c") * 32))
    steps = sorted(stepped.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True)  # some thousand at most
    top, room = stepped.limit(0), plan.known
    for r in steps:
        if r["n"] > room:
            edge = stepped.where(F.col("step") == r["step"]).orderBy(F.col("c").desc(), "word").limit(room)
            top = (stepped.where(F.col("step") > r["step"])).union(edge)
            break
        room -= r["n"]
    else:
        top = stepped
    top = top.select("word", "c").toPandas()
    return top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def scored(docs: DataFrame, held_out, plan: LogBilinear | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text); held_out is a
    condition on docs whose texts are kept out of all counts and training."""
    plan = plan or LogBilinear()
    spark = docs.sparkSession
    training = docs.where(~held_out)
    counts = cut(word_counts(training))
    ends = training.count()
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = total + ends, distinct + (ends > 0)
    size = min(plan.known, max(plan.classes, plan.growth * math.isqrt(distinct)))
    plan = replace(plan, classes=size, contexts=max(plan.contexts, size))
    top = frequent(counts, plan)
    vocabulary = Vocabulary(top["word"].tolist(), top["c"].to_numpy(np.int64), ends, plan)

    # Counts and numbers of words in each form, over all words that are no class of their own.
    own = set(top["word"][: vocabulary.own])

    def by_form(batches):
        sums = np.zeros((2, FORMS), np.int64)
        for batch in batches:
            w = batch.column(0)
            rest = np.array([x not in own for x in w.to_pylist()], bool)
            f = forms(pa.concat_arrays([w.cast(pa.large_string())])) if len(w) else np.zeros(0, np.int64)
            sums[0] += np.bincount(f[rest], batch.column(1).to_numpy()[rest], FORMS).astype(np.int64)
            sums[1] += np.bincount(f[rest], minlength=FORMS)
        yield pa.RecordBatch.from_arrays([pa.array(range(FORMS), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["form", "c", "v"])

    found = counts.mapInArrow(by_form, "form int, c long, v long").groupBy("form").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    in_form = np.zeros((2, FORMS))
    for r in found:
        in_form[:, r["form"]] = r["c"], r["v"]
    share = np.concatenate([vocabulary.counts[: vocabulary.own], [ends], in_form[0]]) + 0.5
    share = share / share.sum()
    model = train(training.select("text"), vocabulary, share)
    base_log = math.log10(n + 0.5 * (v + 1))
    form_log = np.log10(in_form[0] + 0.5 * (in_form[1] + 1))
    c = vocabulary.counts
    base_of = np.log10(c + 0.5) - base_log
    rank = np.arange(len(c))
    within = np.where(rank < vocabulary.own, 0.0, np.log10(c + 0.5) - form_log[np.maximum(vocabulary.output - vocabulary.own - 1, 0)])
    box = spark.sparkContext.broadcast((vocabulary, model, model.positions(), base_of, within, form_log))
    end_log = math.log10(ends + 0.5) - base_log

    def run(batches):
        from pyspark import TaskContext

        row, (vocabulary, model, t, base_of, within, form_log) = TaskContext.get().partitionId() << 40, box.value
        for batch in batches:
            for piece in kernel.pieces(batch, limit=2 << 20):
                y, before, ids, distinct, place, starts, begins = vocabulary.tokens(lowered(piece.column("text")))
                p = np.empty(len(y))
                for at in range(0, len(y), 16384):
                    s = slice(at, at + 16384)
                    p[s] = model.log_probability(t[0][before[0][s]] + t[1][before[1][s]] + t[2][before[2][s]], y[s])
                score = kernel.per_text(p / math.log(10), begins)
                at = place[ids]
                known, safe = at >= 0, np.maximum(at, 0)
                rare_form = np.where(known, 0, np.concatenate([y, [0]])[np.arange(len(ids)) + np.repeat(np.arange(len(starts) - 1), np.diff(starts))] - vocabulary.own - 1)
                base = kernel.per_text(np.where(known, base_of[safe] if len(base_of) else 0.0, -base_log), starts) + end_log
                score += kernel.per_text(np.where(known, within[safe] if len(within) else 0.0, -form_log[rare_form]), starts)
                texts = piece.num_rows
                rows = np.arange(row, row + texts)
                row += texts
                n_known = kernel.per_text(known.astype(np.int64), starts) + (ends > 0)
                text = np.repeat(np.arange(texts), np.diff(starts))[~known]
                pairs, times = np.unique(text * np.int64(max(1, len(distinct))) + ids[~known], return_counts=True)
                rare = distinct.take(pa.array(pairs % max(1, len(distinct)))).cast(pa.string())
                marks = pa.array([f" {r}" for r in rows], pa.string())  # no word has a blank: these meet no count
                m = len(pairs)
                none = lambda kind: pa.nulls(m, kind)
                columns = [pa.concat_arrays(x) for x in (
                    [pa.array(rows), pa.array(rows[pairs // max(1, len(distinct))])], [marks, rare], [pa.array(np.ones(texts, np.int64)), pa.array(times.astype(np.int64))],
                    [piece.column("doc_id").cast(pa.int64()), none(pa.int64())], [piece.column("held_out"), none(pa.bool_())],
                    [pa.array(np.diff(begins)), none(pa.int64())], [pa.array(n_known), none(pa.int64())], [pa.array(base), none(pa.float64())], [pa.array(score), none(pa.float64())],
                )]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    schema = "row long, word string, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    parts = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, schema)
    rare = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    of_word = F.col("n_tokens").isNull()
    met = parts.join(counts, "word", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum("n_known"), F.lit(0)) + F.coalesce(F.sum(F.when(of_word & F.col("c").isNotNull(), F.col("times"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(F.when(of_word, rare)), F.lit(0.0))).alias("base_score"), (F.sum("score") + F.coalesce(F.sum(F.when(of_word, rare)), F.lit(0.0))).alias("score"),
    )
    return met.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id"), 5) == 1)
