"""Packing token sequences: sum-of-squares bin packing over pieces of tokenized documents."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

#: The white space below U+0530.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def plain_characters() -> str:
    """The characters below U+0530 that the tokenizer's normalizer maps one by one: composed
    already, no marks that could join a neighbour, and with a small form of one character."""
    own = map(chr, range(0x530))
    return "".join(c for c in own if unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and unicodedata.category(c) != "Cn" and len(c.lower()) == 1)


def of_category(kind: str) -> str:
    """The characters of a general category that plain ones and their small forms can be."""
    return "".join(sorted({c for p in plain_characters() for c in (p, p.lower()) if unicodedata.category(c)[0] == kind}))


class WordTokenizer:
    """A byte-pair tokenizer of words (runs of letters, single digits, runs of other signs), for
    many texts at once.

    As no token crosses a word, the distinct words of some texts are tokenized once, and the
    texts' ids are put together from them. The merges run in tiktoken: a line feed, which is no
    part of a word, stands for the end of one. Texts with characters that are not plain, or with
    one of the file's special tokens, go through the tokenizer's own program.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        spec, self.special = own["model"], [t["content"] for t in own["added_tokens"]]
        end = spec["end_of_word_suffix"]
        # a byte's sign in the file: itself if it is printable, else the next free one from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        sign = {b: c for c, b in signs.items()}
        in_bytes = lambda t: bytes(signs[c] for c in t.removesuffix(end)) + b"\n" * t.endswith(end)
        order = [sign[b] + end for b in range(256)] + [a + b for a, b in map(lambda m: m.split(" ") if isinstance(m, str) else m, spec["merges"])] + [sign[b] for b in range(256)]
        ranks = {in_bytes(t): i for i, t in enumerate(order)}
        self.ids_of = np.array([spec["vocab"][t] for t in order], np.uint32)
        self.ends = np.array([t.endswith(end) for t in order])
        self.nothing = ranks[b"\n"]
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        letters, numbers = of_category("L"), of_category("N")
        self.plain = "^[" + "".join(f"\\x{{{ord(c):x}}}" for c in plain_characters()) + "]*$"
        self.cuts = f"('s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{SPACES}{letters}{numbers}]+)"

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each one's begin and end."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py() + "\n"
        got = self.merger.encode_to_numpy(joined, disallowed_special=())
        empty = got == self.nothing
        at = np.concatenate([[0], np.cumsum(~empty)[self.ends[got] | empty]])
        return self.ids_of[got[~empty]], at

    def raw(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; of a null one, none."""
        texts = pc.fill_null(texts, "")
        plain = pc.match_substring_regex(texts, self.plain)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, token))
        cut = pc.utf8_lower(pc.if_else(plain, texts, ""))
        cut = pc.replace_substring_regex(cut, self.cuts, r" \1 ")
        for c in SPACES.replace(" ", ""):
            cut = pc.replace_substring(cut, c, " ")
        cut = pc.split_pattern(cut, " ")
        words = cut.flatten().dictionary_encode()
        ids, at = self.of_words(words.dictionary)
        order = words.indices.to_numpy()
        parts = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(ids)).take(pa.array(order)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[order])])[cut.offsets.to_numpy()]
        all_ = parts.astype("<u4", copy=False).tobytes()
        out = [all_[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            own = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids
            out[i] = pack(f"<{len(own)}I", *own)
        return out

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw(pa.array([text], pa.string()))[0], "<u4").tolist()


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return WordTokenizer(path)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, placed largest first by the sum-of-squares rule.

    counts[g] is the number of open bins with residual gap g. An item of size s may go to a bin
    with gap g >= s, which becomes gap g - s, or open a new one; the choice makes the sum of the
    squared counts least (gap 0 does not count: such a bin is closed). Ties take the smallest gap.
    """
    order = np.argsort(-sizes, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened, far = 0, np.iinfo(np.int64).max
    for i in order.tolist():
        s = int(sizes[i])
        # change of the sum for every gap g >= s: one bin leaves g, one arrives at g - s
        change = 2 * (counts[: capacity + 1 - s] - counts[s:]) + 2
        change[0] = 1 - 2 * counts[s]
        change[counts[s:] == 0] = far
        fresh = 2 * counts[capacity - s] + 1 if s < capacity else 0
        g = int(change.argmin())
        if change[g] <= fresh and change[g] != far:
            gap = g + s
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - gap
        if left := gap - s:
            open_bins[left].append(b)
            counts[left] += 1
    return bins, offsets


PIECES = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, doc_key, piece, start, length, ids_crc32[, ids]): tokenized documents, cut.

    doc_key is a digest of id and text that spreads the pieces. Null and empty texts give one
    piece of the end token alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer_of(tokenizer), pack("<I", end_id)
        for part in sliced(batches, 1, 8_000_000):
            out: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), tok.raw(part.column(1)), strict=True):
                ids += end
                key = zlib.crc32(f"{doc_id}".encode(), zlib.crc32(ids))
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    out.append((doc_id, key, k, start // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[: len(types)], types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "doc_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, shard: int = 40_000, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids if with_ids). A document is its token ids and one end id; only longer ones are cut.
    Null and empty texts are the end id alone; repeated rows and null ids are packed like others;
    an empty table gives no rows; extra columns are not read.

    Pieces are dealt by digest into shards of about `shard` pieces, whatever their source, and
    each shard is packed on its own, so a task's memory is bounded; a shard ends with a few open
    bins at most, a small share of its sequences.
    """
    cut = written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    shards = max(1, round(cut.count() / shard))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=bins + (np.int64(key[0]) << 32), offset=offsets)[names]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_key", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, schema)
