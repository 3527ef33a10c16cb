"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, sliced


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18  #: hashed terms
    factors: int = 8
    #: bound on the labelled documents that are brought to the driver for fitting
    max_train: int = 12_000
    examples: int = 40_000  #: about so many are learned from, in whole passes, two at least
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 7


class Terms(dict):
    """word -> bucket; remembered up to a bound. A word also counts by its first five and first seven letters."""

    def __init__(self, buckets: int, bound: int = 200_000):
        super().__init__()
        self.buckets, self.bound = buckets, bound

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.clear()
        letters = word.decode("utf-8", "replace")
        out = self[word] = (zlib.crc32(word) % self.buckets, *(zlib.crc32(letters[:n].encode(), n) % self.buckets for n in (5, 7)))
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a text, ascending."""
        words = set(alnum_words(text))
        return np.unique(np.array([b for w in words for b in self[w]], np.int64))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the buckets present."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        v = self.v[buckets]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.w[buckets].sum()) + pairs, -30, 30))))


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> FactorizationMachine:
    """Adagrad on the logistic loss, over all buckets that occur.

    A bucket enters with a value from 0 to 1 that says how far its log odds stand out, so that a
    rare or indifferent term moves little. The values are a part of the weights returned.
    """
    n, pos = len(rows), sum(y for _, y in rows)
    if not pos or pos == n:
        return FactorizationMachine(float(np.log((pos + 0.5) / (n - pos + 9.5))), np.zeros(s.buckets, np.float32), np.zeros((s.buckets, s.factors), np.float32))
    y = np.array([y for _, y in rows], np.float32)
    df = [np.bincount(np.concatenate([b for b, of in rows if of == k]), minlength=s.buckets) for k in (0, 1)]
    gain = np.abs(np.log((df[1] + 0.5) / (pos + 1) / ((df[0] + 0.5) / (n - pos + 1)))) * np.sqrt(df[0] + df[1])
    value = (gain / max(gain.max(), 1e-9)).astype(np.float32)
    rng = np.random.default_rng(s.seed)
    bias, bias_sq = float(np.log((pos + 0.5) / (n - pos + 0.5))), 1.0
    w, v = np.zeros(s.buckets, np.float32), rng.normal(0, 0.02, (s.buckets, s.factors)).astype(np.float32)
    w_sq, v_sq = np.ones_like(w), np.ones_like(v)
    # rows without a term have one place of value 0
    value = np.concatenate([value, [np.float32(0)]])
    w, v, w_sq, v_sq = (np.concatenate([x, x[:1]]) for x in (w, v, w_sq, v_sq))
    own = [b if len(b) else np.array([s.buckets]) for b, _ in rows]
    sizes = np.array([len(b) for b in own])
    for _ in range(max(2, -(-s.examples // n))):
        order = rng.permutation(n)
        for at in range(0, n, s.batch):
            part = order[at : at + s.batch]
            f, of, starts = np.concatenate([own[i] for i in part.tolist()]), np.repeat(np.arange(len(part)), sizes[part]), np.cumsum(sizes[part]) - sizes[part]
            x = value[f]
            xv = v[f] * x[:, None]
            sums = np.add.reduceat(xv, starts, axis=0)
            pairs = (sums**2 - np.add.reduceat(xv * xv, starts, axis=0)).sum(1)
            z = bias + np.add.reduceat(w[f] * x, starts) + 0.5 * pairs
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32)
            # gradients of the buckets of the batch, w and v side by side
            g = np.empty((len(f), 1 + s.factors), np.float32)
            g[:, 0] = e[of] * x
            np.multiply(sums[of] - xv, g[:, :1], out=g[:, 1:])
            by = np.argsort(f, kind="stable")
            u = f[by]
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            u, g = u[first], np.add.reduceat(g[by], first, axis=0)
            for p, sq, own_g in ((w, w_sq, g[:, 0]), (v, v_sq, g[:, 1:])):
                now = p[u]
                own_g = own_g + np.float32(s.decay) * now
                total = sq[u] + own_g * own_g
                sq[u] = total
                p[u] = now - np.float32(s.rate) * own_g / np.sqrt(total)
            bias_sq += float(e.sum()) ** 2
            bias -= s.rate * float(e.sum()) / bias_sq**0.5
    return FactorizationMachine(bias, (w * value)[:-1], (v * value[:, None])[:-1])


def trained(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> FactorizationMachine:
    """A machine fitted to the labelled documents of docs, at most s.max_train of them (chosen by a
    hash of the id). labels: doc_id, toxic; nulls are ignored, of repeated ids the largest counts.
    Repeated rows of docs count as often as they occur; a null text has no terms. With labels of
    one kind only, or none, every text has the same score. Other columns are not read."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(s.buckets)
        for batch in sliced(batches, 1, 2_000_000):
            out = [of.of(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(out, pa.binary())], ["toxic", "buckets"])

    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text").mapInArrow(terms, "toxic int, buckets binary")
    rows = sorted((bytes(r["buckets"]), r["toxic"]) for r in joined.toLocalIterator())
    return fit([(np.frombuffer(b, np.int32).astype(np.int64), y) for b, y in rows], s)


def scored(docs: DataFrame, machine: FactorizationMachine, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every row of docs, repeated ones and null ids too; a null or empty text
    is scored as no terms; an empty table gives no rows. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # as large as the settings say

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, machine = Terms(s.buckets), shared.value
        for batch in sliced(batches, 1, 2_000_000):
            out = [machine.score(of.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
