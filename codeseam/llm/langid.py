"""Language identification by unigram piece models with all segmentations summed."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, sliced, small_batches

#: Runs of letters and marks; everything else is not evidence of a language.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"


@dataclass(frozen=True)
class Settings:
    #: bound on the labelled documents of each language that its model is fitted to
    max_train: int = 1_000
    rounds: int = 3  #: of expectation maximization
    #: a longer run of letters is cut into parts of so many for fitting (for scoring it is whole)
    part: int = 48
    smooth: float = 0.1


def pieces_of(path: str) -> dict[str, int]:
    """The vocabulary of a sentencepiece model as piece -> number: those of letters, lower-cased
    alike. The mark of a word's start is kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if WORDS.fullmatch(p.removeprefix(START)) and p == p.lower()}
    return {p: i for i, p in enumerate(sorted(found))}


class Pieces:
    """Numbers of the pieces that lie in strings, for many strings of one length at once."""

    def __init__(self, pieces: dict[str, int], bits: int = 20):
        self.longest, self.spare, self.mask = max(map(len, pieces), default=1), len(pieces), np.uint64((1 << bits) - 1)
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [(p, i) for p, i in pieces.items() if len(p) == n]
            chars = np.array([[ord(c) for c in p] for p, _ in own], np.uint64).reshape(len(own), n)
            keys = np.zeros(len(own), np.uint64)
            for i in range(n):
                keys = self.longer(keys, chars[:, i])
            order = np.argsort(keys)
            known = np.zeros(1 << bits, bool)
            known[(keys & self.mask).astype(np.int64)] = True
            self.tables.append((known, keys[order], np.array([i for _, i in own], np.int64)[order]))

    @staticmethod
    def longer(keys: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Hashes of strings with one more character each."""
        out = (keys ^ chars) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))

    def find(self, strings: list[str]) -> list[np.ndarray]:
        """For k = 1, 2, ...: the piece of k characters that starts at each place of each string
        (a column), or -1. A character outside the vocabulary is the spare piece, so every string
        has a segmentation."""
        n = len(strings[0])
        chars = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), n).T.astype(np.uint64)
        out, keys = [], np.zeros((n + 1, len(strings)), np.uint64)
        for k, (known, sorted_keys, numbers) in enumerate(self.tables[:n], 1):
            keys = self.longer(keys[:-1], chars[k - 1 :])
            got = np.full(keys.shape, -1, np.int32)
            if len(sorted_keys):
                maybe = known[(keys & self.mask).astype(np.int64)]
                own = keys[maybe]
                at = np.minimum(np.searchsorted(sorted_keys, own), len(sorted_keys) - 1)
                got[maybe] = np.where(sorted_keys[at] == own, numbers[at], -1)
            out.append(got)
        out[0][out[0] < 0] = self.spare
        return out

    def runs(self, strings: list[str], most: int) -> Iterator[list[str]]:
        """Strings of one length together, at most `most` characters (or one string) at a time."""
        for n, own in groupby(sorted(strings, key=len), len):
            own, size = list(own), max(1, most // n)
            yield from (own[at : at + size] for at in range(0, len(own), size))


class Model:
    """Per-language piece probabilities; prob[piece] is a row with one column per language."""

    def __init__(self, langs: list[str], prob: np.ndarray, pieces: dict[str, int]):
        self.langs, self.prob, self.pieces = langs, prob, pieces


class Judge:
    """A model with a memory of the words it has scored, of at most `cells` numbers; a task has
    its own."""

    def __init__(self, model: Model, cells: int = 500_000):
        self.langs, self.find = model.langs, Pieces(model.pieces)
        self.bound = cells // max(4, len(model.langs))
        self.prob = np.vstack([model.prob, np.zeros(len(model.langs))])  # -1 has no probability
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words of one length: all segmentations summed, end by end."""
        found = self.find.find([START + w for w in words])
        shape = (len(words), len(self.langs))
        # sums for the last ends, the latest first; older ones reach no further end
        last = deque([np.ones(shape)], len(found))
        scale = np.zeros(shape)
        for end in range(1, len(words[0]) + 2):
            total = np.zeros(shape)
            for k, (by_start, before) in enumerate(zip(found, last, strict=False), 1):
                at = by_start[end - k]
                if k == 1:
                    total += before * self.prob[at]
                elif len(some := np.flatnonzero(at >= 0)):
                    total[some] += before[some] * self.prob[at[some]]
            last.appendleft(total)
            if end % 16 == 0:  # keep the numbers in range
                top = np.maximum(total, 1e-300)
                last = deque((x / top for x in last), len(found))
                scale += np.log(top)
        return np.log(np.maximum(last[0], 1e-300)) + scale

    def learn(self, words: set[str]) -> None:
        """Remembers the log probabilities of words; forgets all others first if there is no room."""
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > self.bound:
            self.known, self.logs, missing = {}, np.zeros((0, len(self.langs))), list(words)
        rows = [self.logs]
        for run in self.find.runs(missing, 60_000):
            rows.append(self.forward(run))
            self.known.update(zip(run, range(len(self.known), len(self.known) + len(run)), strict=True))
        self.logs = np.concatenate(rows)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior probability) with equal priors; und and 0 without letters."""
        counts = [Counter(WORDS.findall(t.lower())) if t and self.langs else Counter() for t in texts]
        self.learn(set().union(*counts))
        out = []
        for c in counts:
            if not c:
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), float, len(c)) @ self.logs[at]
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(counts: dict[str, int], pieces: dict[str, int], s: Settings) -> np.ndarray:
    """Piece probabilities of one language: expected counts over all segmentations of its words
    (forward and backward sums), in a few rounds. The last entry is the spare piece."""
    find = Pieces(pieces)
    parts: Counter = Counter()
    for w, n in counts.items():
        w = START + w
        for at in range(0, len(w), s.part):
            parts[w[at : at + s.part]] += n
    p = np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1))
    for _ in range(s.rounds):
        expected = np.full(len(p), s.smooth)
        for run in find.runs(list(parts), 500_000):
            found, n = find.find(run), len(run[0])
            q = [np.where(f >= 0, p[f], 0.0) for f in found]
            fwd, bwd = np.zeros((n + 1, len(run))), np.zeros((n + 1, len(run)))
            fwd[0] = bwd[n] = 1
            for end in range(1, n + 1):
                for k in range(1, min(len(q), end) + 1):
                    fwd[end] += fwd[end - k] * q[k - 1][end - k]
            for start in range(n - 1, -1, -1):
                for k in range(1, min(len(q), n - start) + 1):
                    bwd[start] += bwd[start + k] * q[k - 1][start]
            share = np.array([parts[w] for w in run]) / fwd[n]
            for k, f in enumerate(found, 1):
                weight = fwd[: n + 1 - k] * q[k - 1] * bwd[k:] * share
                expected += np.bincount(f[f >= 0], weight[f >= 0], len(p))
        p = expected / expected.sum()
    return p


def trained(docs: DataFrame, vocabulary: str, s: Settings = Settings()) -> Model:
    """Models of the languages of docs (doc_id, text, lang); rows without one of them are ignored.

    Each is fitted, in a task of its own, to about s.max_train documents of its language, chosen
    by a hash of the id. Repeated rows count as often as they occur; an empty table gives no language.
    """
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1, 0)), {})
    # of a language with more than max_train documents, the share whose hash is below a limit
    limit = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, s.max_train / n) * 2**53))))
    some = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.try_element_at(limit, F.col("lang")))
    words = some.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = pieces_of(vocabulary)

    def fit_one(rows: pa.Table) -> pa.Table:
        counts = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
        return pa.table({"lang": [rows["lang"][0].as_py()], "prob": pa.array([fit(counts, pieces, s)], pa.list_(pa.float64()))})

    got = {r["lang"]: r["prob"] for r in words.groupBy("lang").applyInArrow(fit_one, "lang string, prob array<double>").collect()}
    langs = sorted(got)
    return Model(langs, np.array([got[x] for x in langs]).reshape(len(langs), len(pieces) + 1).T, pieces)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1, 4_000_000):
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])


def identified(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two columns added, the language and its probability (columns of these names are
    replaced).

    und with score 0 where text is null or has no letter, or no language was learned. Every row,
    repeated ones too, and every other column stays as it is; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times vocabulary
    keep = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    (judged,) = fresh(docs.columns, "judged")

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge_ = Judge(shared.value)
        for part in texts:
            out, held, size = [], [], 0
            for text in part:
                held.append(text)
                size += len(text or "")
                if size > 500_000:
                    out += judge_.judge(held)
                    held, size = [], 0
            yield pd.DataFrame(out + judge_.judge(held), columns=["lang", "score"])

    of = F.pandas_udf(judge, "lang string, score double")
    return docs.select(*keep, of(F.col("text")).alias(judged)).select(*keep, F.col(f"{judged}.lang").alias(lang), F.col(f"{judged}.score").alias(score))
