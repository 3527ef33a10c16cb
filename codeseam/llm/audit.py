"""Audit of text filters and of how they interact: every order, and exact Shapley shares."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, written

#: The filters, one letter each; bit i of a mask says that a document fails the i-th.
FILTERS = "ABCDE"
#: All orders of the filters, as strings and as numbers of filters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PLACES = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256))
UPPER, SIGNS, CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """The mask of the filters that a text (UTF-8) fails by itself: A to D."""
    words = text.translate(SPACED).split(b" ")
    words = [w for w in words if w]
    points, upper = len(text.translate(None, CONTINUED)), len(text) - len(text.translate(None, UPPER))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * points) << 2 | signs << 3


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every row: the filters that its text alone fails, and the
    SHA-256 of the text."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 8_000_000):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            masks, digests = [own_failures(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, and
    how many of them are labelled good or toxic."""
    small_batches(docs.sparkSession)
    rows = written(failures(docs), "failures")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    whole = rows.join(first.hint("merge"), "digest", "left").join(marks.hint("merge"), "doc_id", "left")
    mask = F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0))
    return whole.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def removal_polynomial(counts: list[int]) -> list[int]:
    """The coefficients, by set of variables, of the multilinear polynomial of removed documents.

    If filter i is on with probability x_i, a document of mask m goes with probability
    1 - prod over i in m of (1 - x_i). Multiplied out, the product over T has the coefficient
    (-1) ** (|T| + 1) times the number of documents whose mask holds T.
    """
    above = np.array(counts, np.int64)
    for i in range(len(counts).bit_length() - 1):
        halves = above.reshape(-1, 2, 1 << i)
        halves[:, 0] += halves[:, 1]
    return [0] + [int(c) if t.bit_count() % 2 else -int(c) for t, c in enumerate(above) if t]


def corners(polynomial: list[int]) -> np.ndarray:
    """The polynomial's value for every set of filters that are on, the others off."""
    out = np.array(polynomial, np.int64)
    for i in range(len(polynomial).bit_length() - 1):
        halves = out.reshape(-1, 2, 1 << i)
        halves[:, 1] += halves[:, 0]
    return out


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The filter's share: the integral from 0 to 1 of the partial derivative by x_i where all
    variables are equal to t. A product over T that has i becomes t ** (|T| - 1)."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))


#: Long columns of an audit besides part, filter_order and step.
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_of(n: list[int], good: list[int], toxic: list[int]) -> np.ndarray:
    """One row of FIGURES for each order and step, from counts by mask."""
    polynomial, k = removal_polynomial(n), len(FILTERS)
    gone, good_gone, toxic_gone = (corners(p) for p in (polynomial, removal_polynomial(good), removal_polynomial(toxic)))
    after = np.cumsum(1 << PLACES, axis=1)
    before = after - (1 << PLACES)
    fails = np.array([gone[1 << i] for i in range(k)])[PLACES]
    alone = np.array([gone[-1] - gone[(1 << k) - 1 - (1 << i)] for i in range(k)])[PLACES]
    shares = [shapley(polynomial, i) * factorial(k) for i in range(k)]
    removed = gone[after] - gone[before]
    out = [sum(n) - gone[after], removed, fails - removed, alone, good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], np.array([int(s) for s in shares])[PLACES]]
    return np.stack([x.reshape(-1) for x in out])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters remove the documents of each part, in every order.

    docs has doc_id, text and source, labels doc_id, quality and toxic. A text fails A with under
    50 words, B if under 65 in 100 words are distinct, C if over 5 in 100 code points are A-Z, D if
    it holds one of #$%&*|, E if any row with a lesser doc_id has the same text. Returns for each
    part (source), order of the filters and step: part, filter_order, step (from 1) and FIGURES:
    documents kept after the step, removed in it, failing its filter but removed before, failing
    its filter only, removed in it though labelled good, or toxic, and 120 times the filter's
    Shapley share of all removals of the part.

    A null text is empty, a null source the part ''. A row with a null doc_id neither fails E nor
    makes another fail it, and has no label; rows that repeat a doc_id are all counted, and are
    not lesser than each other. Of several labels of a document any counts. An empty table gives
    no rows; extra columns are not read. Only counts by mask, 32 for each part at most, meet.
    """
    counts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    size = len(ORDERS) * len(FILTERS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = pa.array(np.repeat(ORDERS, len(FILTERS))), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_mask = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in own:
                    by_mask[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                figures = audit_of(*by_mask.tolist())
                yield pa.RecordBatch.from_arrays([pa.array([part] * size), orders, steps, *map(pa.array, figures)], ["part", "filter_order", "step", *FIGURES])

    return counts.mapInArrow(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in FIGURES))
