"""A log-bilinear language model trained by noise-contrastive estimation, and its scores."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_words, sliced, written

#: The token after the last word; as white space it is no word.
END = b"\n"
#: The low bits of a word's hash hold its ending, which stands for a rarer word.
ENDINGS = 128


@dataclass(frozen=True)
class Settings:
    #: most frequent words that are predicted one by one; the others share 128 endings
    words: int = 16_384
    #: most frequent words that are told apart as contexts; the others share 128 endings
    own: int = 384
    head: int = 100_000  #: bound on the words whose counts every task holds
    shard: int = 2_000_000  #: about so many tokens are one task's training run
    size: int = 32  #: of a vector
    noise: int = 24  #: samples for each batch
    batch: int = 2048
    rate: float = 0.1
    seed: int = 11


class WordCode(dict):
    """word -> 64-bit code: a hash whose low 7 bits are those of the last three bytes' hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = (xxhash.xxh3_64_intdigest(word) & ~(ENDINGS - 1)) | (zlib.crc32(word[-3:]) & (ENDINGS - 1))
        h = self[word] = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def tokens(text: str | None) -> list[bytes]:
    words = blank_words(text)
    words.append(END)
    return words


def counted(docs: DataFrame) -> DataFrame:
    """(code, n): how often each token occurs in docs; summed in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = WordCode(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code.of(list(seen))), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

        for batch in batches:
            for text in (x.as_py() for x in batch.column(0)):
                seen.update(tokens(text))
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the frequent words, and what stands for each: as a predicted word, itself or its
    ending; as a context, a class, which is itself for fewer words or its ending."""

    total: int
    types: int
    codes: np.ndarray  #: of the frequent words, ascending
    logs: np.ndarray  #: log10(count + 1) of each
    outs: np.ndarray  #: number as a predicted word
    classes: np.ndarray  #: class as a context
    words: int
    own: int
    out_counts: np.ndarray
    log_sums: np.ndarray  #: log10 of the sum of count + 1 over what an ending stands for and one unseen; 0 for words

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, class, log10(count + 1), known to be frequent) of every token."""
        ending = codes & (ENDINGS - 1)
        if not len(self.codes):
            return self.words + ending, self.own + ending, np.zeros(len(codes)), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        there = self.codes[at] == codes
        return np.where(there, self.outs[at], self.words + ending), np.where(there, self.classes[at], self.own + ending), np.where(there, self.logs[at], 0.0), there


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """The frequent words are all those with a count above the least threshold that keeps them
    within s.head; no more of the table comes to the driver than them and sums."""
    ending = F.col("code").bitwiseAND(F.lit(ENDINGS - 1))
    sums = {r["e"]: (r["n"], r["types"]) for r in counts.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    kept, least = 0, None
    for step, words in steps:
        if kept + words > s.head:
            break
        kept, least = kept + words, step
    head = [] if least is None else [(r["n"], r["code"]) for r in counts.where(F.floor(F.log2("n") * 8) >= least).collect()]
    head.sort(key=lambda x: (-x[0], x[1]))
    codes, n = np.array([c for _, c in head], np.int64), np.array([n for n, _ in head], float)
    endings, rank = codes & (ENDINGS - 1), np.arange(len(head))
    words, own = min(s.words, len(head)), min(s.own, len(head))
    out_counts, totals = np.zeros(words + ENDINGS), np.ones(ENDINGS)
    for e, (count, types) in sums.items():
        out_counts[words + e], totals[e] = count, count + types + 1
    out_counts[:words] = n[:words]
    np.subtract.at(out_counts, words + endings[:words], n[:words])
    np.subtract.at(totals, endings[:words], n[:words] + 1)
    order = np.argsort(codes)
    of = lambda k: np.where(rank < k, rank, k + endings)[order]
    return Vocabulary(sum(n for n, _ in sums.values()), sum(t for _, t in sums.values()), codes[order], np.log10(n + 1)[order], of(words), of(own), words, own, out_counts, np.concatenate([np.zeros(words), np.log10(totals)]))


@dataclass
class LogBilinear:
    """log p(w | u, v) = (C1 x_u + C2 x_v) . r_w + b_w - log Z, u the previous class, v the one before."""

    r: np.ndarray
    b: np.ndarray
    x: np.ndarray
    c: np.ndarray  #: two square matrices

    @classmethod
    def start(cls, words: Vocabulary, s: Settings) -> LogBilinear:
        rng = np.random.default_rng(s.seed)
        p = (words.out_counts + 1) / (words.out_counts.sum() + len(words.out_counts))
        r, x = (rng.normal(0, 0.1, (n, s.size)).astype(np.float32) for n in (len(p), words.own + ENDINGS))
        return cls(r, np.log(p).astype(np.float32), x, np.stack([np.eye(s.size) * 0.3] * 2).astype(np.float32))

    def log_z(self) -> np.ndarray:
        """The normaliser of every pair of contexts. As exp(a + b) = exp(a) exp(b), the sums over
        all words are one matrix product."""
        first, second = (self.x.astype(float) @ c.T @ self.r.T for c in self.c)
        first += self.b
        top = first.max(1), second.max(1)
        z = np.exp(first - top[0][:, None]) @ np.exp(second - top[1][:, None]).T
        return np.log(z) + top[0][:, None] + top[1][None, :]

    def packed(self, weights: np.ndarray, n: float) -> np.ndarray:
        """All parameters as rows, times the weight of each row, which is the last column."""
        d = self.r.shape[1]
        rows = np.zeros((len(self.r) + len(self.x) + 2 * d, d + 2))
        rows[:, :d] = np.concatenate([self.r, self.x, self.c.reshape(2 * d, d)])
        rows[: len(self.r), d], rows[:, d + 1] = self.b, 1
        return rows * np.concatenate([weights, np.full(len(rows) - len(weights), n)])[:, None]

    def unpacked(self, rows: np.ndarray) -> LogBilinear:
        k, m, d = len(self.r), len(self.x), self.r.shape[1]
        rows = (rows[:, : d + 1] / rows[:, d + 1 :]).astype(np.float32)
        return LogBilinear(rows[:k, :d], rows[:k, d], rows[k : k + m, :d], rows[k + m :, :d].reshape(2, d, d))


def contexts(classes: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before every token of some texts and the one before that; END before a text's first."""
    u = np.concatenate([[end], classes[:-1]])
    u[starts] = end
    v = np.concatenate([[end], u[:-1]])
    v[starts] = end
    return u, v


class Trainer:
    """Noise-contrastive estimation in batches with Adagrad; noise is shared within a batch."""

    def __init__(self, model: LogBilinear, out_counts: np.ndarray, s: Settings, seed: int):
        self.m = LogBilinear(model.r.copy(), model.b.copy(), model.x.copy(), model.c.copy())
        self.s, self.rng = s, np.random.default_rng(seed)
        q = (out_counts + 1) / (out_counts.sum() + len(out_counts))
        self.cdf, self.log_noise = np.cumsum(q), np.log(q * s.noise).astype(np.float32)
        self.sq = [np.full_like(x, 1e-4) for x in (self.m.r, self.m.b, self.m.x, self.m.c)]

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        drawn = np.minimum(np.searchsorted(self.cdf, self.rng.random(self.s.noise)), len(self.cdf) - 1)
        xu, xv, rw, rn = m.x[u], m.x[v], m.r[w], m.r[drawn]
        q = xu @ m.c[0].T + xv @ m.c[1].T
        good = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", q, rw) + m.b[w] - self.log_noise[w], -30, 30))) - 1
        bad = 1 / (1 + np.exp(-np.clip(q @ rn.T + m.b[drawn] - self.log_noise[drawn], -30, 30)))
        dq = good[:, None] * rw + bad @ rn
        outs, dr = by_row(np.concatenate([w, drawn]), np.concatenate([np.column_stack([good[:, None] * q, good]), np.column_stack([bad.T @ q, bad.sum(0)])]))
        ins, dx = by_row(np.concatenate([u, v]), np.concatenate([dq @ m.c[0], dq @ m.c[1]]))
        dc = np.stack([dq.T @ xu, dq.T @ xv])
        for p, at, g, sq in zip((m.r, m.b, m.x, m.c), (outs, outs, ins, slice(None)), (dr[:, :-1], dr[:, -1], dx, dc), self.sq, strict=True):
            g = (g / n).astype(np.float32)
            total = sq[at] + g * g
            sq[at] = total
            p[at] -= self.s.rate * g / np.sqrt(total)


def by_row(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in `at`, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts], np.add.reduceat(rows[order], starts, axis=0)


#: Rows of parameters that move together, and how many sums of them are added in one task.
BLOCK, FAN = 2048, 32


def trained(docs: DataFrame, words: Vocabulary, s: Settings) -> LogBilinear:
    """The model from all of docs. Documents are dealt out by a digest into shards of about
    s.shard tokens, whatever their layout; each shard is one run, in the order of ids and texts,
    from the same start, and the parameters are averaged: a word's by how often the shard has it,
    the others by tokens. They are added up in rounds, FAN of a kind at a time; one set of them
    reaches the driver."""
    start = LogBilinear.start(words, s)
    d = s.size
    shared = docs.sparkSession.sparkContext.broadcast((words, start))  # bounded by the settings
    shards = -(-words.total // s.shard)

    def train(key: tuple, table: pa.Table) -> pa.Table:
        words, start = shared.value
        code = WordCode()
        trainer = Trainer(start, words.out_counts, s, s.seed + key[0].as_py())
        seen = np.zeros(len(start.r))
        texts = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).column("text")
        held: list[np.ndarray] = []
        size = n = 0
        for k, text in enumerate(texts, 1):
            held.append(code.of(tokens(text.as_py())))
            size += len(held[-1])
            if size >= 32 * s.batch or k == len(texts):
                w, classes, _, _ = words.look_up(np.concatenate(held))
                u, v = contexts(classes, starts_of(held), words.look_up(code.of([END]))[1][0])
                seen += np.bincount(w, minlength=len(seen))
                order = trainer.rng.permutation(len(w))
                for at in range(0, len(w), s.batch):
                    part = order[at : at + s.batch]
                    trainer.step(u[part], v[part], w[part])
                n += size
                held, size = [], 0
        rows = trainer.m.packed(seen + 1e-3, n).astype(np.float32)
        blocks = [rows[i : i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)]
        return pa.table({"shard": [key[0].as_py()] * len(blocks), "block": range(len(blocks)), "rows": blocks}, schema=sums)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in table.column("rows"))
        return pa.table({"shard": [key[1].as_py()], "block": [key[0].as_py()], "rows": [total.astype(np.float32).tobytes()]}, schema=sums)

    sums, types = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("rows", pa.binary())]), "shard long, block int, rows binary"
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, shards))).alias("shard"))
    parts, left = dealt.repartition(max(1, shards), "shard").groupBy("shard").applyInArrow(train, types), shards
    while left > 1:
        parts, left = parts.groupBy("block", F.floor(F.col("shard") / FAN).alias("some")).applyInArrow(add, types), -(-left // FAN)
    got = {r["block"]: r["rows"] for r in parts.select("block", "rows").collect()}
    if not got:
        return start
    return start.unpacked(np.frombuffer(b"".join(got[i] for i in sorted(got)), np.float32).astype(float).reshape(-1, d + 2))


def starts_of(parts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, parts[:-1])])


def scored(docs: DataFrame, learn_from: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Log10 probabilities of all texts of docs, learned from those of learn_from.

    Returns for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (log10 of the model's probability: the log-bilinear probability of each
    token after the two before; the words beyond the s.words most frequent share the probability
    of their ending by add-one counts). A null or empty text is its end token. An empty learn_from
    leaves only unseen tokens. Repeated rows and null ids are learned and scored like others; an
    empty table gives no rows; extra columns are not read.

    Counts of frequent words go to every task, bounded by s.head; the tokens below that
    meet their counts in a join on their hash, where no key is hot, for all of them.
    """
    counts = written(counted(learn_from), "counts")
    words = vocabulary(counts, s)
    model = trained(learn_from, words, s)
    shared = docs.sparkSession.sparkContext.broadcast((words, model, model.log_z()))
    unit = float(np.log10(words.total + words.types + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m, log_z = shared.value
        code, row = WordCode(), TaskContext.get().partitionId() << 40
        end = words.look_up(code.of([END]))[1][0]
        first, second = (m.x @ c.T for c in m.c)
        for batch in sliced(batches, 1, 1_000_000):
            own = [code.of(tokens(t.as_py())) for t in batch.column(1)]
            codes, starts = np.concatenate(own), starts_of(own)
            w, classes, logs, there = words.look_up(codes)
            u, v = contexts(classes, starts, end)
            p = (np.einsum("ij,ij->i", first[u] + second[v], m.r[w]) + m.b[w] - log_z[u, v]) / np.log(10)
            p += np.where(w >= words.words, logs - words.log_sums[w], 0.0)
            total = lambda x: np.add.reduceat(x, starts)
            sizes = np.array([len(x) for x in own])
            rows = row + np.arange(len(own))
            row += len(own)
            # one row for the document itself, whose code meets no count, and one for each rare token
            doc = np.repeat(np.arange(len(own)), sizes)[~there]
            rare = codes[~there]
            order = np.lexsort((rare, doc))
            doc, rare = doc[order], rare[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])])) if len(rare) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([new, [len(rare)]]))
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (rows ^ np.int64(1 << 62), np.zeros(len(own), np.int64), rows, sizes, total(there.astype(np.int64)), total(logs) - sizes * unit, total(p)))], names)
            zeros, none = np.zeros(len(new), np.int64), np.zeros(len(new))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[new])), *map(pa.array, (rare[new], times[: len(new)], rows[doc[new]], zeros, zeros, none, none))], names)

    names = ["doc_id", "code", "k", "row", "n_tokens", "n_known", "base", "score"]
    parts = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, code long, k long, row long, n_tokens long, n_known long, base double, score double")
    log = F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)
    known = F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)
    out = parts.join(counts, "code", "left").select("row", "doc_id", "n_tokens", known.alias("n_known"), (F.col("base") + log).alias("base"), (F.col("score") + log).alias("score"))
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
