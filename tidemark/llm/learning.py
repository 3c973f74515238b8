"""Operators 3 and 6: toxicity from positive and unlabelled text, quality from subword embeddings.

Both fit with numpy on the driver, on a sample whose size is a parameter, and score every whole text on the
executors. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import fsum

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import base, bpe

FOLDS = 5

_words = re.compile(r"\w+").findall


def held_out(column: str = "doc_id"):
    """Rows that never teach a label: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(False))


def _first(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most rows doc_ids, in the order of a hash: the same ones on every run."""
    ids = df.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def _taught(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """kind, text of the documents of ids(doc_id, kind), saved: one text a doc_id and kind, however many rows share the
    doc_id (the least of them), so that rows are bounded by ids."""
    found = base.texts(docs).join(F.broadcast(ids), "doc_id").groupBy("kind", "doc_id").agg(F.min("text").alias("text"))
    return base.saved(found.select("kind", "text"), "taught")


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = score()
        for batch in batches:
            got = np.fromiter((each(t) for t in batch.column("text").to_pylist()), np.float64, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    out = base.texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


# ---------------------------------------------------------------- toxicity


@dataclass(frozen=True)
class NonNegativePU:
    """A linear classifier on hashed words (each distinct word of a text counts once), fitted by the non-negative risk
    estimator prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss. Its bias is
    what the risk makes it: score 0.5 is where the class prior puts it.

    prior: share of positives in unlabelled text; None: the share of labelled training rows that are positive.
    positives, unlabelled: most labelled training rows that are learnt from as confirmed positives, and as unlabelled
    text (whatever their label, which isn't looked at). buckets: of words. least_docs, least_z, least_lift: a
    bucket is learnt if that many positives have it, and it stands out in them by that many standard
    errors and that many times; however many do so. penalty: L2.
    """

    prior: float | None = None
    positives: int = 4000
    unlabelled: int = 8000
    buckets: int = 1 << 18
    least_docs: int = 3
    least_z: float = 3.0
    least_lift: float = 1.5
    steps: int = 200
    rate: float = 0.1
    penalty: float = 1e-5
    beta: float = 0.0
    seed: int = 7

    def bucket(self, word: str) -> int:
        return xxhash.xxh32_intdigest(word) % self.buckets

    def features(self, text: str) -> np.ndarray:
        """Buckets of the distinct words, in ascending order; two words may share one."""
        return np.sort(np.fromiter(map(self.bucket, set(_words(text.lower()))), np.int64))

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[dict[int, float], float] | None:
        """Weights of buckets, and the bias; None if there is no positive row to learn from.

        The driver gets counts of buckets (2 * buckets numbers at most) and, of each row learnt from, those buckets
        that are learnt."""
        taught = labels.filter(~held_out() & F.col(label).isNotNull())
        share = taught.agg(F.avg(F.col(label).cast("double"))).first()[0]
        pos = _first(taught.filter(F.col(label) == 1), self.positives, self.seed).withColumn("kind", F.lit(1))
        unl = _first(labels, self.unlabelled, self.seed + 1).withColumn("kind", F.lit(0))
        rows = _taught(docs, pos.unionByName(unl))
        count = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
        if set(count) != {0, 1}:
            return None

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, self.buckets), np.int64)
            for batch in batches:
                for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    n[kind, np.unique(self.features(text))] += 1
            kind, at = np.nonzero(n)
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(n[kind, at])], ["kind", "bucket", "n"])

        seen = rows.mapInArrow(counted, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros((2, self.buckets))
        n[seen.column("kind").to_numpy(), seen.column("bucket").to_numpy()] = seen.column("n").to_numpy()
        learnt = np.flatnonzero(self.stands_out(n[1], count[1], n[0], count[0]))
        place = np.full(self.buckets, -1)
        place[learnt] = np.arange(len(learnt))

        def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [x[x >= 0] for x in (place[self.features(t)] for t in batch.column("text").to_pylist())]
                yield pa.record_batch([batch.column("kind"), pa.array(at, pa.list_(pa.int32()))], ["kind", "at"])

        got = rows.mapInArrow(used, "kind int, at array<int>").toArrow()
        lists = got.column("at").combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        weights, bias = self._descend(row, np.asarray(lists.flatten()), got.column("kind").to_numpy(), len(learnt), self.prior if self.prior is not None else float(share))
        return dict(zip(learnt.tolist(), weights.tolist(), strict=True)), float(bias)

    def stands_out(self, in_pos, n_pos, in_unl, n_unl):
        both = (in_pos + in_unl) / (n_pos + n_unl)
        z = (in_pos / n_pos - in_unl / n_unl) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl) + 1e-12)
        return (z >= self.least_z) & (in_pos >= self.least_docs) & (in_pos / n_pos >= self.least_lift * in_unl / n_unl)

    def risk(self, w, b, row, col, kind, prior):
        """The risk of the positives, that of the negatives (which the estimator cuts off at 0), and a gradient: of
        their sum, or, where the latter is under -beta, up that one alone."""
        pos, unl = kind == 1, kind == 0
        f = np.bincount(row, w[col], minlength=len(kind)) + b
        s = sigmoid(f)  # d loss(f, -1) / d f; d loss(f, +1) / d f = s - 1
        negative = np.logaddexp(0, f)
        rest = negative[unl].mean() - prior * negative[pos].mean()
        d = np.zeros(len(kind))
        if rest >= -self.beta:
            d[pos] = prior * (s[pos] - 1 - s[pos]) / pos.sum()
            d[unl] = s[unl] / unl.sum()
        else:  # the estimated risk of negatives fell below what a risk can be: climb back
            d[pos] = prior * s[pos] / pos.sum()
            d[unl] = -s[unl] / unl.sum()
        return prior * np.logaddexp(0, -f[pos]).mean(), rest, np.append(np.bincount(col, d[row], minlength=len(w)), d.sum())

    def _descend(self, row, col, kind, size, prior):
        prior = min(max(prior, 1e-3), 0.999)
        w, b = np.zeros(size), np.log(prior / (1 - prior))
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        for t in range(1, self.steps + 1):
            g = self.risk(w, b, row, col, kind, prior)[2]
            g[:-1] += self.penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return w, b


def _toxic_score(model: NonNegativePU, known: tuple[dict[int, float], float] | None):
    if known is None:
        return lambda text: 0.0
    weights, bias = known
    memory = bpe.Memory(lambda word: weights.get(model.bucket(word), 0.0), 200_000)
    return lambda text: float(sigmoid(bias + fsum(map(memory.__getitem__, set(_words(text.lower()))))))  # in any order


def toxicity(docs: DataFrame, labels: DataFrame, model: NonNegativePU | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text).

    Null text: empty; an empty text gets the score of the bias. Labels with a null doc_id teach nothing, and those
    without a label no positive; repeated labels count once, and rows that share a labelled doc_id teach by one text. With no positive training row every score is 0. Null or repeated doc_ids are scored
    like others; other columns are ignored; an empty table gives an empty result.
    """
    model = model or NonNegativePU()
    sent = docs.sparkSession.sparkContext.broadcast(model.fit(docs, labels))  # at most NonNegativePU.buckets entries

    return _scored(docs, lambda: _toxic_score(model, sent.value), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, model: NonNegativePU | None = None, threshold: float = 0.5) -> DataFrame:
    """docs, all its columns, without the rows whose score is threshold or more; nothing moves between tasks. Rows are
    judged one by one: doc_id may be null or repeated, a null text counts as empty and comes through as null."""
    model = model or NonNegativePU()
    sent = docs.sparkSession.sparkContext.broadcast(model.fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _toxic_score(model, sent.value)
        for batch in batches:
            yield batch.filter(pa.array([each(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# ---------------------------------------------------------------- quality


@dataclass(frozen=True)
class SubwordEmbeddings:
    """Hashed vectors of words, character n-grams and word pairs, averaged per document, and a softmax layer.

    A word's vector is the mean over the word and its n-grams (with < and > at its ends); a pair of neighbours
    has one vector, and all pairs of equal words share one. rows: most labelled rows of each class that
    are learnt from, weighted so that classes count as in the training labels.
    """

    buckets: int = 1 << 15
    size: int = 8
    grams: tuple[int, ...] = (3, 4)
    rows: int = 1000
    epochs: int = 4
    batch: int = 32
    rate: float = 0.5
    seed: int = 11

    def word(self, w: str) -> list[int]:
        """Buckets of a word and its n-grams."""
        s, m = f"<{w}>", self.buckets - 1
        found = [s, *(s[i : i + n] for n in self.grams for i in range(len(s) - n + 1))]
        return [h % m + 1 for h in map(xxhash.xxh32_intdigest, found)]

    def pairs(self, words: list[str]) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        out = (base.mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(self.buckets - 1)).astype(np.int64) + 1
        out[h[:-1] == h[1:]] = 0
        return out

    def features(self, text: str, memory) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their weights in the average of a text."""
        words = text.split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        each = list(map(memory.__getitem__, words))
        n = np.fromiter(map(len, each), np.int64, len(each))
        pairs, all_ = self.pairs(words), 2 * len(words) - 1
        at = np.concatenate([np.fromiter(chain.from_iterable(each), np.int64, int(n.sum())), pairs])
        value = np.concatenate([np.repeat(1 / n, n), np.ones(len(pairs))]) / all_
        total = np.bincount(at, value, minlength=self.buckets)
        used = np.flatnonzero(total)
        return used.astype(np.int32), total[used].astype(np.float32)

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float] | None:
        """Each bucket's part in the log-odds of label 1, and the bias; None without both classes."""
        taught = labels.filter(~held_out() & F.col(label).isin(0, 1))
        count = dict(taught.groupBy(label).count().collect())
        if set(count) != {0, 1}:
            return None
        ids = [_first(taught.filter(F.col(label) == k), self.rows, self.seed).withColumn("kind", F.lit(k)) for k in (0, 1)]
        taught_rows = _taught(docs, ids[0].unionByName(ids[1]))  # 2 * rows at most, of buckets numbers each at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory = bpe.Memory(self.word, 100_000)
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    got = [self.features(t, memory) for t in part.column("text").to_pylist()]
                    cols = [part.column("kind"), pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float32()))]
                    yield pa.record_batch(cols, ["kind", "at", "value"])

        rows = taught_rows.mapInArrow(run, "kind int, at array<int>, value array<float>").toArrow()
        kind = rows.column("kind").to_numpy()
        if set(kind.tolist()) != {0, 1}:
            return None
        at, value = rows.column("at").combine_chunks(), np.asarray(rows.column("value").combine_chunks().flatten())
        ends = np.cumsum(np.asarray(at.value_lengths()))
        share = np.array([count[0], count[1]]) / (count[0] + count[1])
        weight = (share / (np.bincount(kind) / len(kind)))[kind]
        return self._descend(np.asarray(at.flatten()), value, ends, kind, weight)

    def _descend(self, at, value, ends, kind, weight):
        rng = np.random.default_rng(self.seed)
        table = rng.uniform(-1 / self.size, 1 / self.size, (self.buckets, self.size))
        out, bias = rng.normal(0, 0.1, (self.size, 2)), np.zeros(2)
        square = np.full((self.buckets, self.size), 1e-8)
        square_out, square_bias = np.full(out.shape, 1e-8), np.full(2, 1e-8)
        begins, target = np.append(0, ends[:-1]), np.eye(2)[kind]
        for _ in range(self.epochs):
            order = rng.permutation(len(kind))
            for b in range(0, len(order), self.batch):
                docs = order[b : b + self.batch]
                spans = [np.arange(begins[d], ends[d]) for d in docs]
                of, flat = np.repeat(np.arange(len(docs)), list(map(len, spans))), np.concatenate(spans)
                x, where = value[flat].astype(np.float64), at[flat]
                used, local = np.unique(where, return_inverse=True)
                mix = np.bincount(of * len(used) + local, x, minlength=len(docs) * len(used)).reshape(len(docs), -1)
                vec = mix @ table[used]
                logit = vec @ out + bias
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - target[docs]) * weight[docs][:, None] / len(docs)
                g_out, g_bias, g_table = vec.T @ d, d.sum(axis=0), mix.T @ (d @ out.T)
                for w, sq, g, rows in ((out, square_out, g_out, ...), (bias, square_bias, g_bias, ...), (table, square, g_table, used)):
                    sq[rows] += g * g
                    w[rows] -= self.rate * g / np.sqrt(sq[rows])
        return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def quality(docs: DataFrame, labels: DataFrame, model: SubwordEmbeddings | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text).

    Null text: empty; a text without words gets the score of the bias. Labels that are null or neither 0 nor 1
    teach nothing; repeated labels count once, and rows that share a labelled doc_id teach by one text. Without training rows of both classes every score is 0.5. Null or
    repeated doc_ids are scored like others; other columns are ignored; an empty table gives an empty result.
    """
    model = model or SubwordEmbeddings()
    sent = docs.sparkSession.sparkContext.broadcast(model.fit(docs, labels))  # one number a bucket

    def score():
        if sent.value is None:
            return lambda text: 0.5
        part, bias = sent.value
        get = part.tolist().__getitem__

        def mean(w: str) -> float:
            at = model.word(w)
            return sum(map(get, at)) / len(at)

        memory = bpe.Memory(mean, 600_000)

        def one(text: str) -> float:
            words = text.split()
            if not words:
                return float(sigmoid(bias))
            total = sum(map(memory.__getitem__, words)) + float(part[model.pairs(words)].sum(dtype=np.float64))
            return float(sigmoid(bias + total / (2 * len(words) - 1)))

        return one

    return _scored(docs, score, threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))
