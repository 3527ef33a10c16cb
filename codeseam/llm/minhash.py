"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, blank_words, components, ends, hint, mixed, seen, written

#: Documents of one mapInArrow batch are hashed in runs of about this many shingles.
RUN = 200_000


def shingle_set(text: str | None, hashes: WordHash, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one."""
    h = hashes.of(blank_words(text))
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = mixed(out) + h[i : i + n]
    return np.unique(mixed(out))


def permute32(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers (xorshift and odd multipliers)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of `size` MinHash coordinates for each non-empty set.

    Two permutations of the universe of 32-bit integers: the first (`mixed`, cut to 32 bits)
    scatters the elements, the second is shifted by k places, circularly, for coordinate k.
    """
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    first = (mixed(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(permute32(first - np.uint32(k)), at)
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, size = signatures.shape
    rows = size // bands
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    parts = signatures.reshape(n, bands, rows).astype(np.uint64)
    for i in range(rows):
        keys = mixed(keys ^ mixed(parts[:, :, i]))
    return keys.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys): set size, 128-bit digest of the set, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, texts, start = batch.column(0).cast(pa.int64()), batch.column(1), 0
            while start < len(texts):
                sets, total, stop = [], 0, start
                while stop < len(texts) and total < RUN:
                    sets.append(shingle_set(texts[stop].as_py(), hashes, width))
                    total += len(sets[-1])
                    stop += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(circulant_signatures([sets[i] for i in full], bands * rows), bands) if full else np.empty((0, bands), np.int64)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if full:
                    at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
                    joined = np.concatenate([sets[i] for i in full])
                    a[full] = np.add.reduceat(mixed(joined), at)
                    b[full] = np.add.reduceat(mixed(joined ^ np.uint64(0x5851F42D4C957F2D)), at)
                counts = np.zeros(len(sets), np.int32)
                counts[full] = bands
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )
                start = stop

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def hinted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents in `wanted` and of few others: the hashed shingle set of
    each. Nothing is moved: a hint sorts out most others."""
    shared = hint(wanted.select(F.xxhash64("doc_id").alias("h")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            batch = batch.filter(pa.array(seen(shared.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                own = [shingle_set(t, hashes, width) for t in part.column(1).to_pylist()]
                at = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own).view(np.int64)))], ["doc_id", "shingles"])

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).where("doc_id is not null")
    return rows.mapInArrow(sets, "doc_id long, shingles array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents in `wanted`. Only these sets, and few others, are moved."""
    return hinted_sets(docs, wanted, width).join(wanted.hint("merge"), "doc_id", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    n, m = F.size("x"), F.size("y")
    close = (n > 0) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    same = F.when(close, F.size(F.array_intersect("x", "y")))
    return both.where(same * (100 + percent) >= (n + m) * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 20, rows: int = 4, width: int = 5) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of percent/100.

    Returns for each row of docs: doc_id, n_shingles, component_id (the least doc_id reachable
    through links), kept (doc_id = component_id). Rows with the same doc_id are one node. A
    document without words, or with a null text, is linked to nothing; a null doc_id has a null
    component and is kept. Extra columns of docs are not read.

    Equal sets fold into one representative first, so any number of exact copies costs one row
    each. Every bucket then compares its members with one member: as many candidate pairs
    as members, however large the bucket. Members of a bucket that end in several components may
    still hold unseen links among themselves; they alone go through an exact prefix-filter join
    (two sets this similar share one of the rarest shingles of each), so no link is lost to the
    shortcut. With 20 bands of 4 rows a pair at 0.85 is missed with probability 4e-7.
    """
    base = written(signed(docs, bands, rows, width), "signatures")
    classes = written(base.where("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes")
    # keys depend on the set alone: those of the representative's row will do
    members = base.join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")).hint("merge"), ["set_a", "set_b", "doc_id"]).select("doc_id", F.explode("keys").alias("key")).distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    in_bucket = written(members.join(sizes.hint("merge"), "key"), "buckets")
    # A bucket is compared with the member that shares the most buckets with others: of the
    # copies of a text that is most often the text itself, nearest to all of them.
    fame = in_bucket.groupBy("doc_id").agg(F.sum("size").alias("fame"))
    ranked = in_bucket.join(fame.hint("merge"), "doc_id").select("key", "doc_id", F.struct("fame", (-F.col("doc_id")).alias("low")).alias("rank"))
    pivots = ranked.groupBy("key").agg((-F.max("rank")["low"]).alias("pivot"))
    pairs = in_bucket.join(pivots.hint("merge"), "key").where("doc_id <> pivot").select(F.greatest("doc_id", "pivot").alias("a"), F.least("doc_id", "pivot").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    sets = shingle_sets(docs, ends(pairs), width)
    links = written(confirmed(pairs, sets, percent), "links")
    roots = components(links)

    # buckets of three or more that are not yet in one component
    placed = in_bucket.where("size > 2").join(roots.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = written(placed.join(open_keys.hint("merge"), "key", "left_semi").select("doc_id", "root").distinct(), "open")
    if rest.limit(1).count():
        more = prefix_pairs(docs, rest, percent, width).join(pairs, ["a", "b"], "left_anti")
        more = written(more, "pairs")
        if more.limit(1).count():
            found = written(confirmed(more, shingle_sets(docs, ends(more), width), percent), "links")
            roots = components(links.union(found))

    rooted = classes.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("component"))
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(rooted.hint("merge"), ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def prefix_pairs(docs: DataFrame, rest: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a > b) of documents of `rest` (doc_id, root) in different components that can still
    link: all that pass three tests that no similar pair fails.

    Two sets this similar share one of the rarest shingles of each (the prefix filter); their
    shingles from the first common one on, in order of rarity, are enough for both sizes; and
    shingles that no other document of `rest` has count for no one, which leaves too few in
    common for copies with many own changes.
    """

    sets = shingle_sets(docs, rest.select("doc_id"), width).join(rest.hint("merge"), "doc_id")
    tokens = written(sets.select("doc_id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    df = tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # the shingles of one document lie together, as many as it has itself
    own = Window.partitionBy("doc_id")
    shared = tokens.join(df.hint("merge"), "shingle").withColumn("m", F.count("*").over(own)).where(f"m * 100 >= n * {percent}")
    # the shingles that it shares with no one come first in its order: they fill n - m places
    shared = shared.withColumn("rank", F.row_number().over(own.orderBy("df", "shingle")))
    prefix = shared.where(f"rank + n - m <= n - ceil(n * {percent} / 100.0) + 1").select("shingle", "doc_id", "root", "n", "m", "rank")
    # a shingle whose documents are all in one component can add nothing
    split = prefix.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    prefix = written(prefix.join(split.hint("merge"), "shingle", "left_semi"), "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    apart = (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root"))
    # at their first common shingle, no more than what follows it in each can be common
    left = 1 + F.least(F.col("x.m") - F.col("x.rank"), F.col("y.m") - F.col("y.rank"))
    enough = left * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & apart & enough).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those that are near copies of a document with a lesser id."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
