"""Helpers shared by the corpus operators: text to words, written tables, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, but every ASCII byte that is no letter or digit becomes a blank.
ALNUM = bytes(b if b >= 128 else LOWER[b] if chr(b).isalnum() else 32 for b in range(256))
#: As LOWER, but the ASCII white space (blank, tab to carriage return) becomes a blank and
#: the other bytes that bytes.split() would cut at (none) stay.
BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else LOWER[b] for b in range(256))

MASK = (1 << 64) - 1


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space (blank, tab, LF, VT, FF, CR)."""
    return text.encode("utf-8", "surrogatepass").translate(BLANKS).split() if text else []


def sliced(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column `text` holds at most `most` bytes, or one row.

    What a task derives from texts is as large as they are; a batch has up to 10,000 of them.
    """
    for batch in batches:
        column = batch.column(text)
        sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)) + 64
        at, total = np.cumsum(sizes), 0.0
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(at, total + most, "right")))
            yield batch.slice(start, stop - start)
            start, total = stop, at[stop - 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> stable 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def doc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; the fold that the contracts name."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until none of the columns has it."""
    taken = {c.lower() for c in columns}
    return [next(x for x in (n + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and all
    tasks run on this machine."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeseam-"))
        there = spark.sparkContext.getCheckpointDir()
    return there


#: Rows that move to and from Python at a time: texts can be long, and a batch is held whole.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH_ROWS, if they are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/codeseam/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by written(), once nothing reads it again."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ends(pairs: DataFrame, name: str = "doc_id") -> DataFrame:
    """The distinct ids on either side of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()


#: Bits of a hint: with it goes a bitmap of this many bits, 4 MB, whatever the number of ids.
HINT_BITS = 25


def hint(hashes: DataFrame) -> Broadcast:
    """A bitmap of fixed size that holds every 64-bit hash of a one-column table and, of others,
    few.

    It lets a scan skip most rows that a semi-join would drop, before they are moved; the join
    still decides. With very many hashes it lets more through, never fewer.
    """
    h = F.col(hashes.columns[0])
    slot = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << (HINT_BITS - 6)) - 1))
    bit = F.expr(f"shiftleft(1L, cast({hashes.columns[0]} & 63 as int))")
    got = hashes.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (HINT_BITS - 6), np.int64)
    words[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(words)


def seen(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap of a hint may hold."""
    h = hashes.view(np.uint64)
    slot = ((h >> np.uint64(6)) & np.uint64((1 << (HINT_BITS - 6)) - 1)).astype(np.int64)
    return (words.view(np.uint64)[slot] >> (h & np.uint64(63))) & np.uint64(1) > 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) -> (node, root), root the least id.

    Alternates the large-star and small-star steps until the edges no longer change; each
    round is written to the shared folder and the one before removed. Only nodes with an edge to
    another node appear. A node with very many neighbours is one key of two joins, whose other
    side has one row for it, so that adaptive execution can split it.
    """

    def print_of(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    def two(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        pair = lambda x: F.struct(F.col(x[0]).alias("a"), F.col(x[1]).alias("b"))
        return df.select(F.explode(F.array(pair(first), pair(second))).alias("e")).select("e.a", "e.b")

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = print_of(e)
    for _ in range(rounds):
        if not now[0]:
            break
        both = two(e, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), both["a"] == low["k"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = two(large.join(low.hint("merge"), large["a"] == low["k"]), ("b", "m"), ("a", "m")).where("a <> b")
        last, e = e, written(small.distinct(), "edges")
        was, now = now, print_of(e)
        dropped(last)
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return two(e, ("a", "b"), ("b", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("root"))
