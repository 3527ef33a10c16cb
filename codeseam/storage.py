"""Tables in a shared folder that cut lineage, and bitmaps of hashes that save moving rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read column by column."""
    path = f"{shared_dir(df.sparkSession)}/codeseam/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a shuffle that a task reads, about.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows (about so many) dealt out by keys over as many partitions as keep what one task
    sorts or groups the same, however many there are; never over fewer than shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


#: Bits of a bitmap: 8 MB, whatever the number of hashes.
BITMAP_BITS = 26


def bitmap(hashes: DataFrame) -> Broadcast:
    """A bitmap of fixed size that holds every 64-bit hash of a one-column table and few others.
    With very many hashes it holds more others, never fewer hashes."""
    name = hashes.columns[0]
    slot = F.shiftrightunsigned(F.col(name), 6).bitwiseAND(F.lit((1 << (BITMAP_BITS - 6)) - 1))
    bits = hashes.select(slot.alias("slot"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    words[bits.column("slot").to_numpy()] = bits.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(words)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap may hold."""
    h = hashes.view(np.uint64)
    slot = ((h >> np.uint64(6)) & np.uint64((1 << (BITMAP_BITS - 6)) - 1)).astype(np.int64)
    return (words.view(np.uint64)[slot] >> (h & np.uint64(63))) & np.uint64(1) > 0
