"""Fill-in-the-middle texts: a parallel automaton scan finds where to cut, however long the text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, written

#: Kinds of bytes: white space (blank, tab to carriage return), <, a letter of a marker, >, other.
BLANK, OTHER, LESS, LETTER, GREATER = range(5)
KIND = np.array([BLANK if b == 32 or 9 <= b <= 13 else LESS if b == 60 else GREATER if b == 62 else LETTER if b in b"PSM" else OTHER for b in range(256)], np.uint8)
#: States: after white space or at the start, in a word, after < and after < with a letter.
SPACE, WORD, OPEN, NAMED = range(4)
#: The automaton: the next state by state and kind. It counts a token's end where white space
#: follows a word, and a marker where > follows NAMED.
NEXT = np.array([[SPACE, WORD, OPEN, NAMED if s == OPEN else WORD, WORD] for s in range(4)])
#: Kinds of summaries of a chunk, each a list by start state.
SUMMARY = "ends array<long>, marks array<long>, last array<int>"


def scanned(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the automaton does on a chunk, for each start state: the number of token ends and of
    markers that it counts, and the state it ends in."""
    kind = KIND[np.frombuffer(chunk, np.uint8)]
    ends, marks = np.full(4, 0, np.int64), np.full(4, 0, np.int64)
    if len(kind):
        ends += np.count_nonzero((kind[1:] == BLANK) & (kind[:-1] != BLANK))
        ends[1:] += kind[0] == BLANK
        marks += np.count_nonzero((kind[:-2] == LESS) & (kind[1:-1] == LETTER) & (kind[2:] == GREATER)) if len(kind) > 2 else 0
        marks[NAMED] += kind[0] == GREATER
        marks[OPEN] += len(kind) > 1 and kind[0] == LETTER and kind[1] == GREATER
    last = np.arange(4)
    for k in kind[-3:]:  # three bytes decide the state, whatever came before
        last = NEXT[last, k]
    return ends, marks, last


def composed(first: tuple, then: tuple) -> tuple:
    """The summary of one run of chunks followed by another; arrays have a row for each pair."""
    (a, b, c), (x, y, z) = first, then
    at = lambda v: np.take_along_axis(v, c, -1)
    return a + at(x), b + at(y), at(z)


def prefixes(summaries: tuple) -> tuple:
    """Row i summarises chunks 0 to i: composition is associative, so it takes log2 n steps."""
    out, step = tuple(np.array(x) for x in summaries), 1
    while step < len(out[0]):
        joined = composed(tuple(x[:-step] for x in out), tuple(x[step:] for x in out))
        out = tuple(np.concatenate([x[:step], j]) for x, j in zip(out, joined, strict=True))
        step *= 2
    return out


def end_in(chunk: bytes, start: int, j: int) -> int:
    """Where the j-th (from 1) token end of a chunk entered in a state lies."""
    blank = KIND[np.frombuffer(chunk, np.uint8)] == BLANK
    before = np.concatenate([[start == SPACE], blank[:-1]])
    return int(np.flatnonzero(blank & ~before)[j - 1])


def plan(doc_id: int | None, n: int, marks: int, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int]:
    """The form of a document of n tokens, and after which of them its prefix and middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    form = "plain" if not n or marks or h3 % 100 >= rate else "spm" if h4 % 100 < spm_rate else "psm"
    return form, min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def points(text: bytes) -> int:
    """Code points of a piece of UTF-8, by their first bytes."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def assembled(text: bytes, form: str, a: int, b: int) -> tuple[bytes, int | None, int | None]:
    """The text in its form, cut at bytes a and b, and the code points of prefix and middle."""
    if form == "plain":
        return text, None, None
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    out = b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle) if form == "psm" else (b"<S>", suffix, b"<P>", prefix, b"<M>", middle))
    return out, points(prefix), points(middle)


def restored(form: str | Column, output: str | Column) -> Column:
    """The text that a form and output were made from. The text has no marker, and a marker can't
    overlap another, so the first of each kind is the one that was put in."""
    form, out = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    first, second = F.when(form == "psm", "<S>").otherwise("<P>"), F.lit("<M>")
    at, last = F.instr(out, first), F.instr(out, second)
    one, two, middle = F.substring(out, F.lit(4), at - 4), F.substring(out, at + 3, last - at - 3), F.substring(out, last + 3, F.char_length(out))
    return F.when(form == "plain", out).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


RESULT = "n long, form string, prefix_chars long, middle_chars long, output binary"
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
RESULTS = [c.split()[0] for c in RESULT.split(", ")]


def short_ones(docs: DataFrame, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """Documents that are one chunk, scanned, cut and put together in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 4_000_000):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                ends, marks, _ = scanned(text)
                n = int(ends[SPACE]) + (len(text) > 0)
                form, *units = plan(doc_id, n, int(marks[SPACE]), seed, rate, spm_rate)
                at = [0 if form == "plain" or not k else len(text) if k == n else end_in(text, SPACE, k) for k in units]
                whole, a, b = assembled(text, form, *at)
                out.append((doc_id, n, form, a, b, whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *TYPES], strict=True)], ["doc_id", *RESULTS])

    return docs.mapInArrow(cut, f"doc_id long, {RESULT}")


def chunked(long_ones: DataFrame, chunk: int) -> DataFrame:
    """(rid, no, bytes): the chunks of long documents, cut at any byte, spread over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, most = memoryview(text.as_buffer()), 64 * chunk
                for start in range(0, len(view), most):
                    own = [view[i : i + chunk].tobytes() for i in range(start, min(len(view), start + most), chunk)]
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(own), pa.int64()), pa.array(range(start // chunk, start // chunk + len(own)), pa.int64()), pa.array(own, pa.binary())], ["rid", "no", "bytes"])

    return long_ones.select("rid", "text").mapInArrow(cut, "rid long, no long, bytes binary").repartition("rid", "no")


def summarised(chunks: DataFrame) -> DataFrame:
    """(rid, no, size, ends, marks, last): each chunk's summary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(len(c), *scanned(c)) for c in batch.column(2).to_pylist()]
            if own:
                size, ends, marks, last = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(list(ends), pa.list_(pa.int64())), pa.array(list(marks), pa.list_(pa.int64())), pa.array([x.tolist() for x in last], pa.list_(pa.int32()))], ["rid", "no", "size", "ends", "marks", "last"])

    return chunks.mapInArrow(scan, f"rid long, no long, size long, {SUMMARY}")


def planned(long_ones: DataFrame, summaries: DataFrame, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """(rid, n, form, cuts): of each long document, from its chunks' summaries alone. A cut is the
    chunk it lies in, the chunk's start and entry state, and which of its token ends it is; a cut
    at the document's start or end has the entry state -1."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, doc_id, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ends, marks, last = prefixes(tuple(np.array([x[k] for x in own], np.int64) for k in ("ends", "marks", "last")))
                starts = np.concatenate([[0], np.cumsum([x["size"] for x in own])])
                n = int(ends[-1, SPACE]) + 1
                form, *units = plan(doc_id, n, int(marks[-1, SPACE]), seed, rate, spm_rate)
                cuts = []
                for k in units if form != "plain" else ():
                    i = int(np.searchsorted(ends[:, SPACE], k))
                    if 0 < k < n:
                        cuts.append({"no": i, "start": int(starts[i]), "state": int(last[i - 1, SPACE]) if i else SPACE, "j": k - (int(ends[i - 1, SPACE]) if i else 0)})
                    else:
                        cuts.append({"no": -1, "start": int(starts[-1]) if k else 0, "state": -1, "j": 0})
                out.append((rid, n, form, cuts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["rid", "n", "form", "cuts"])

    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("no", pa.int64()), ("start", pa.int64()), ("state", pa.int32()), ("j", pa.int64())]))]
    gathered = summaries.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("no", "size", "ends", "marks", "last"))).alias("own"))
    return long_ones.select("rid", "doc_id").join(gathered.hint("merge"), "rid").select("rid", "doc_id", "own").mapInArrow(place, "rid long, n long, form string, cuts array<struct<no:bigint,start:bigint,state:int,j:bigint>>")


def selected(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rid, at): the bytes at which each long document is cut; only chunks with a cut are opened."""
    cuts = plans.select("rid", F.posexplode("cuts").alias("which", "cut")).select("rid", "which", "cut.*")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, which, start, state, j, chunk = (batch.column(i).to_pylist() for i in range(6))
            at = [start[i] if state[i] < 0 else start[i] + end_in(chunk[i], state[i], j[i]) for i in range(len(rid))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], ["rid", "which", "at"])

    found = cuts.join(chunks.hint("merge"), ["rid", "no"], "left").select("rid", "which", "start", "state", "j", "bytes").mapInArrow(find, "rid long, which int, at long")
    return found.groupBy("rid").agg(F.min("at").alias("a"), F.max("at").alias("b"))


def cut_long(docs: DataFrame, chunk: int, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """Documents of several chunks, whose chunks are scanned by different tasks."""
    plans = written(planned(docs, summarised(chunked(docs, chunk)), seed, rate, spm_rate), "plans")
    at = selected(plans, chunked(docs, chunk))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, n, form, a, b, text in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                whole, x, y = assembled(text.as_py(), form, a, b)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((doc_id, n, form, x, y, whole), [pa.int64(), *TYPES], strict=True)], ["doc_id", *RESULTS])

    whole = docs.join(plans.drop("cuts").hint("merge"), "rid").join(at.hint("merge"), "rid", "left")
    return whole.select("doc_id", "n", "form", "a", "b", "text").mapInArrow(put, f"doc_id long, {RESULT}")


def filled_in(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = 1 << 16) -> DataFrame:
    """Each document with its middle moved to the end, for fill-in-the-middle training.

    Returns for each row of docs (doc_id, text): doc_id, n (tokens: a word with the white space
    before it, or white space at the end), form, prefix_chars, middle_chars (code points), output.
    Digests of seed and doc_id choose two tokens after which the text is cut and, for `rate` in a
    hundred documents, a form: spm (`spm_rate` in a hundred of these) or psm. A document that is
    empty or holds <P>, <S> or <M> is plain: unchanged, its lengths null.

    A null text is empty; a null doc_id counts as the empty string in the digest; rows that repeat
    a doc_id are treated alike; an empty table gives no rows; extra columns are not read. A text of
    more than `chunk` bytes is cut into chunks that tasks scan by themselves: each gives the
    automaton's transition and its counts for every start state, their composition the state and
    counts before each chunk, and only the chunks that hold a cut are opened again.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    long_text = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    out = short_ones(rows.where(~long_text), seed, rate, spm_rate)
    long_ones = written(rows.where(long_text).withColumn("rid", F.monotonically_increasing_id()), "long_texts")
    if not long_ones.isEmpty():
        out = out.unionByName(cut_long(long_ones, chunk, seed, rate, spm_rate))
    return out.withColumn("output", F.col("output").cast("string"))
