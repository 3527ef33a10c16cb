"""Benchmark decontamination: a join of winnowed fingerprints, extended to whole windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, alnum_words, hint, mixed, seen, sliced, written

#: Up to so many distinct benchmark windows go to every task; more are dealt out by key.
FEW_WINDOWS = 200_000


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out = mixed(out) + h[i : i + n]
    return mixed(out)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """The least hash of every window of w neighbouring grams: the window's fingerprint."""
    n = len(grams) - w + 1
    if n <= 0:
        return grams[:0]
    out = grams[:n]
    for i in range(1, w):
        out = np.minimum(out, grams[i : i + n])
    return out


def prints(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """The fingerprint of every window of n words: the least hash of its k-grams.

    It depends on the window alone, so equal windows always share it. Windows of fewer than k
    words are one gram.
    """
    k = min(k, n)
    return winnow(gram_hashes(h, k), n - k + 1)


def item_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """(n, print, words, items): every distinct window of the items, its number of words, its
    fingerprint, the words themselves and the items that hold it, sorted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches, 1, 2_000_000):
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := alnum_words(text):
                    n = min(window, len(words))
                    marks = prints(hashes.of(words), n, k).view(np.int64).tolist()
                    out += {(n, m, b" ".join(words[i : i + n]), item) for i, m in enumerate(marks)}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["n", "print", "words", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null").distinct()
    found = rows.mapInArrow(cut, "n int, print long, words binary, item string")
    return found.groupBy("n", "print", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


SCANNED = "doc_id long, rid long, n_words long, n int, print long, words binary, places array<struct<rid:long,at:int>>"
PLACE = pa.struct([("rid", pa.int64()), ("at", pa.int32())])
ARROW = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64()), ("n", pa.int32()), ("print", pa.int64()), ("words", pa.binary()), ("places", pa.list_(PLACE))])


def scanned(docs: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows: one with n_words for each document, numbered by rid; and one for each
    distinct window among some megabytes of documents that may be a benchmark's, with its places.

    A window that very many documents hold is thus one row for some thousand of them. Which
    windows may be a benchmark's tells a bitmap of all its fingerprints, of fixed size.
    """
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `window` numbers
    known = hint(windows.select("print"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rid, bits = WordHash(), TaskContext.get().partitionId() << 40, known.value
        for batch in sliced(batches, 1, 4_000_000):
            first, counts = rid, []
            places: dict[tuple, list] = defaultdict(list)
            for text in batch.column(1):
                words = alnum_words(text.as_py())
                counts.append(len(words))
                h = hashes.of(words)
                for n in sizes:
                    marks = prints(h, n, k).view(np.int64)
                    for i in np.flatnonzero(seen(bits, marks)).tolist():
                        places[n, int(marks[i]), b" ".join(words[i : i + n])].append((rid, i))
                rid += 1
            none = [None] * len(counts)
            own = [batch.column(0).cast(pa.int64()), pa.array(range(first, rid), pa.int64()), pa.array(counts, pa.int64()), *(pa.array(none, f.type) for f in list(ARROW)[3:])]
            yield pa.RecordBatch.from_arrays(own, schema=ARROW)
            if places:
                none, at = [None] * len(places), [p for x in places.values() for p in x]
                both = pa.StructArray.from_arrays([pa.array([r for r, _ in at], pa.int64()), pa.array([i for _, i in at], pa.int32())], fields=list(PLACE))
                ends = pa.array(np.cumsum([0, *map(len, places.values())]).astype(np.int32))
                cols = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(none, pa.int64()) for _ in range(3)), *cols, pa.ListArray.from_arrays(ends, both)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(scan, SCANNED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 6) -> DataFrame:
    """Marks the words of documents that lie inside a window of a benchmark item.

    Returns one row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans (merged word ranges), items (sorted as strings). A null or wordless
    text has no words and no hit; an item without words or with a null id or text is ignored; a
    null doc_id stays null; repeated rows of docs are marked alike, those of the benchmark count
    once; an empty table has no rows or no hits; other columns are not read.

    Windows of documents meet those of items in a join on the fingerprint and the words. The
    items' windows go to every task if they are few; else both sides are dealt out by key, and
    adaptive execution splits a key with many rows.
    """
    windows = written(item_windows(benchmark, window, k), "windows")
    rows = written(scanned(docs, windows, k), "scanned")
    few = windows.count() <= FEW_WINDOWS
    met = rows.where("words is not null").select("n", "print", "words", "places").join(F.broadcast(windows) if few else windows.hint("merge"), ["n", "print", "words"])
    hits = met.select(F.explode("places").alias("p"), "n", "items").select("p.rid", F.col("p.at").alias("start"), (F.col("p.at") + F.col("n")).alias("end"), "items")
    items = hits.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # spans that touch are one: a span begins where no earlier one of the document reaches
    order = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("rid", "start", "end", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int").alias("new"))
    spans = begun.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    out = rows.where("words is null").select("doc_id", "rid", "n_words").join(items.join(spans, "rid").hint("merge"), "rid", "left")
    items, spans = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), spans.alias("spans"), items.alias("items"))
