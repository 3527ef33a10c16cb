"""Near-duplicate lines: segment-partition edit join over bytes with banded bit-parallel
verification and, for long lines, a prefix-filter join of word grams for edits of whole words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, components, ends, fresh, hint, mixed, seen, sliced, written

#: Groups of more lines than this that share a segment are compared through one member first.
SMALL = 6
#: Keys that a task holds before it groups them.
HELD = 300_000
#: Words of a gram. A line of w words has w - GRAM + 1 grams, of which an edited word changes GRAM.
GRAM = 5
#: Common grams come last in the order of grams; at most so many are known, from one document in
#: COMMON_OF. Which ones are known changes the cost of the join, not its pairs.
COMMON, COMMON_OF = 1_000_000, 8


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance of a and b is at most `edits`: bit-parallel over a band.

    Common ends are cut first. Then one machine word of 2 * edits + 1 bits holds the vertical
    differences of the band around the diagonal, as the column moves along b.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    i, n = 0, min(len(a), len(b))
    step = 64
    while i < n and step:
        if a[i : i + step] == b[i : i + step] and i + step <= n:
            i += step
        else:
            step //= 2
    a, b = a[i:], b[i:]
    j, n = 0, min(len(a), len(b))
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= edits
    # reach[e] has bit d + edits set if some alignment with e edits is on diagonal d; each is
    # slid along equal characters, all diagonals of the band in one integer per character.
    m, n, width = len(a), len(b), 2 * edits + 1
    full = (1 << width) - 1
    masks: dict[int, int] = defaultdict(int)
    for q in range(min(edits + 1, n)):
        masks[b[q]] |= 1 << (q + edits)
    # row states: bit d of R[e] set: a[:row] reaches b[:row + d - edits] with at most e edits
    states = []
    for e in range(edits + 1):
        states.append(sum(1 << (edits + d) for d in range(e + 1) if d <= n))
    for row in range(m):
        here = masks.get(a[row], 0)
        new, prev_old = [], 0
        for e in range(edits + 1):
            old = states[e]
            s = old & here
            if e:
                s |= prev_old | (prev_old >> 1) | (new[-1] << 1)
            s &= full
            new.append(s)
            prev_old = old
        states = new
        if not states[-1]:
            return False
        # the band moves one along b: every mask slips one place, one character enters
        masks = defaultdict(int, {c: m >> 1 for c, m in masks.items() if m > 1})
        q = row + edits + 1
        if q < n:
            masks[b[q]] |= 1 << (width - 1)
        # drop the diagonals that would lie beyond the end of b
        beyond = row + 1 + edits - n
        if beyond > 0:
            keep = (1 << max(0, width - beyond)) - 1
            states = [s & keep for s in states]
    return bool(states[-1] >> (n - m + edits) & 1)


def word_distance(a: list, b: list) -> int:
    """The edit distance of two sequences, bit-parallel over all of a."""
    if not a:
        return len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = full, 0
    for y in b:
        same = at.get(y, 0)
        zero = (((same & more) + more) ^ more) | same | less
        right, left = less | ~(zero | more) & full, more & zero
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        more, less = left | ~(zero | right) & full, right & zero
    return score


def word_edits(n: int | np.ndarray, share: int) -> int | np.ndarray:
    """How many words of a line of n may be edited: share in a hundred, two at least; none in a
    line so short that share in a hundred is less than one."""
    k = n * share // 100
    return np.maximum(k, 2) * (k > 0)


def linked(a: bytes, b: bytes, edits: int, share: int) -> bool:
    """Whether two lines are within the words that the shorter allows or, if it allows none,
    within `edits` bytes."""
    x, y = (a.split(), b.split()) if share else ((), ())
    k = int(word_edits(min(len(x), len(y)), share))
    if not k:
        return within(a, b, edits)
    if abs(len(x) - len(y)) > k or sum((Counter(x) - Counter(y)).values()) > k:
        return False
    return word_distance(x, y) <= k


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)


def number_in_run(first: np.ndarray, n: int) -> np.ndarray:
    """0, 1, ... within each of the runs that begin at `first`."""
    at = np.arange(n)
    starts = np.zeros(n, np.int64)
    starts[first] = first
    return at - np.maximum.accumulate(starts)


def word_grams(lines: list[bytes], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, hash) of all grams of some lines, and each line's number of words."""
    own = [line.split() for line in lines]
    n = np.fromiter(map(len, own), np.int64, len(own))
    h = hashes.of([w for words in own for w in words])
    of = np.repeat(np.arange(len(lines)), n)
    size = max(0, len(h) - GRAM + 1)
    out = h[:size].copy()
    for i in range(1, GRAM):
        out = mixed(out) + h[i : i + size]
    whole = of[:size] == of[GRAM - 1 : GRAM - 1 + size]
    return of[:size][whole], mixed(out[whole]), n


def numbered(of: np.ndarray, grams: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, gram, ...) by line, with equal grams of a line told apart by their number."""
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.empty(0, np.int64)
    return of, mixed(grams + number_in_run(first, len(of)).astype(np.uint64)), *(x[order] for x in more)


def word_keys(lines: list[bytes], share: int, common: np.ndarray, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, key) of the keys under which a line meets every line within its word
    edits, and each line's number of words. Keys are the line's first grams in an order of all
    grams, common ones last. k edits leave all but k * GRAM of either line's grams to both, so the
    first k * GRAM + 1 of each have one in common."""
    of, grams, n = word_grams(lines, hashes)
    k = word_edits(n, share)
    some = k[of] > 0
    of, grams = of[some], grams[some]
    late = np.zeros(len(of), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    of, named, late = numbered(of, grams, late)
    order = np.lexsort((named, late, of))
    of, named = of[order], named[order]
    early = number_in_run(runs(of), len(of)) <= k[of] * GRAM
    return of[early], named[early], n


def common_grams(docs: DataFrame, share: int) -> np.ndarray:
    """Grams that several lines of one document in COMMON_OF hold, the most frequent ones, ascending."""
    if not share:
        return np.empty(0, np.uint64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches, 0, 250_000):
            lines = {line for text in batch.column(0).to_pylist() if text for line in text.encode("utf-8", "surrogatepass").split(b"\n")}
            of, own, _ = word_grams(list(lines), hashes)
            g, n = np.unique(np.unique(np.stack([own, of.astype(np.uint64)]), axis=1)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_OF)) == 0).select("text")
    counts = some.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "gram").limit(COMMON).select("gram").toArrow()
    return np.sort(got.column("gram").to_numpy().view(np.uint64))


def line_hash(line: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Base of the polynomial hash of substrings (odd, so it has an inverse), and that inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


@cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_keys(lines: list[bytes], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the keys under which a line meets every line within `edits`
    edits: its own segments, and the substrings that could be segments of lines of its length or
    up to `edits` shorter (the choice of starts that suits several matches at once).

    A line of n bytes is cut into edits + 1 segments of n // (edits + 1) bytes; the last
    n % (edits + 1) are one longer. Substrings are hashed by differences of prefix sums.
    """
    chars = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint64) + np.uint64(1)
    room = 1 << max(19, len(chars).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * powers(BASE, room)[: len(chars)])])
    back = powers(UNBASE, room)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    offsets, number = np.cumsum(n) - n, np.arange(len(lines))
    parts, of, keys = edits + 1, [], []
    for delta in range(edits + 1):
        target = n - delta
        short, longer = target // parts, target % parts
        for i in range(parts):
            p, size = i * short + np.maximum(0, i - (parts - longer)), short + (i >= parts - longer)
            lo = np.maximum(np.maximum(0, p - i), p + delta - (edits - i))
            hi = np.minimum(np.minimum(n - size, p + i), p + delta + (edits - i))
            tag = mixed((target * 16 + i).astype(np.uint64))
            for shift in range(2 * edits + 1):
                some = np.flatnonzero((lo + shift <= hi) & (target > edits))
                at = offsets[some] + lo[some] + shift
                of.append(number[some])
                keys.append(mixed((sums[at + size[some]] - sums[at]) * back[at]) ^ tag[some])
    return np.concatenate(of), np.concatenate(keys)


def line_keys(lines: list[bytes], edits: int, share: int, common: np.ndarray, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key): keys under which linked lines meet. Lines that allow word edits
    have keys of words; those that allow none, or may be linked to such a line, keys of bytes."""
    of, keys, n = word_keys(lines, share, common, hashes) if share else (np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(lines), np.int64))
    # an edited byte can cut a word in two
    short = np.flatnonzero(word_edits(n - edits, share) == 0) if share else np.arange(len(lines))
    if len(short):
        by_bytes, more = byte_keys([lines[i] for i in short.tolist()], edits)
        of, keys = np.concatenate([of, short[by_bytes]]), np.concatenate([keys, more])
    return of, keys


def eligible(text: str | None, min_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(number, UTF-8 bytes) of the lines of a text that are compared: those long enough."""
    if text:
        for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
            if len(line) >= min_bytes:
                yield k, line


def occurrences(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(doc_id, line_no, h, g): every compared line with its 128-bit digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 2_000_000):
            ids, nos, hs, gs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, line in eligible(text, min_bytes):
                    ids.append(doc_id)
                    nos.append(k)
                    hs.append(line_hash(line))
                    gs.append(_signed(xxhash.xxh3_64_intdigest(line, 7)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(hs, pa.int64()), pa.array(gs, pa.int64())], ["doc_id", "line_no", "h", "g"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(rows, "doc_id long, line_no int, h long, g long")


ROWS = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("pivot", pa.int64())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], schema=ROWS)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], schema=ROWS)


def grouped(keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows (key, line, pivot) of a task's own groups of lines under a key.

    A small group is passed on whole, with null pivots. A larger one is compared through its
    least line: a candidate pair for each other line, and only that line, marked by being its
    own pivot, goes on to meet lines of other tasks.
    """
    order = np.lexsort((x, keys))
    keys, x = keys[order], x[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (x[1:] != x[:-1])])
    keys, x = keys[new], x[new]
    first = runs(keys)
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    pivot = np.repeat(x[first], sizes)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(x), pa.array(pivot, mask=np.repeat(sizes <= SMALL, sizes))], schema=ROWS)


def keyed(docs: DataFrame, edits: int, min_bytes: int, share: int = 0) -> DataFrame:
    """(key, x, pivot): a line x under each of its keys, grouped within the task beforehand."""
    common = docs.sparkSession.sparkContext.broadcast(common_grams(docs.where("doc_id is not null"), share))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHash(), [], 0
        for batch in sliced(batches, 0, 250_000):
            lines = {line_hash(line): line for text in batch.column(0).to_pylist() for _, line in eligible(text, min_bytes)}
            if not lines:
                continue
            of, keys = line_keys(list(lines.values()), edits, share, common.value, words)
            held.append((keys.view(np.int64), np.fromiter(lines, np.int64, len(lines))[of]))
            size += len(of)
            if size >= HELD:
                yield grouped(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield grouped(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("text").where("doc_id is not null").mapInArrow(rows, "key long, x long, pivot long")


def paired(rows: DataFrame) -> DataFrame:
    """(a, b, hot): candidate pairs from rows that meet under a key; hot holds the key of a group
    that was compared through one line only. Rows that are pairs already go anywhere."""
    done = F.coalesce(F.col("pivot") != F.col("x"), F.lit(False))
    meet = rows.repartition(F.when(done, F.xxhash64("x")).otherwise(F.col("key"))).sortWithinPartitions("key")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            held = [np.empty(0, np.int64)] * 3
            for batch in batches:
                key, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                own = batch.column(2).is_null().to_numpy(zero_copy_only=False)
                pivot = np.where(own, 0, batch.column(2).fill_null(0).to_numpy(zero_copy_only=False))
                # 0: small group, 1: the line through which a larger one was compared, 2: a pair
                kind = np.where(own, 0, np.where(pivot == x, 1, 2))
                for k, line, p in zip(*(c[kind == 2].tolist() for c in (key, x, pivot)), strict=True):
                    yield k, line, p
                rest = kind < 2
                held = [np.concatenate([h, c[rest]]) for h, c in zip(held, (key, x, kind), strict=True)]
                yield from close(held, False)
                last = held[0] == held[0][-1] if len(held[0]) else slice(0)
                held = [np.array(h[last]) for h in held]
            yield from close(held, True)

        def close(held: list[np.ndarray], final: bool) -> Iterator[tuple]:
            """The groups of two or more; the last one only when nothing can follow."""
            key, x, kind = held
            if not len(key):
                return
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            ends_ = edges if final else edges[:-1]
            sizes = np.diff(ends_)
            for at in np.flatnonzero(sizes > 1).tolist():
                lo, hi = int(ends_[at]), int(ends_[at + 1])
                lines = set(x[lo:hi].tolist())
                if len(lines) > SMALL or kind[lo:hi].any():
                    pivot = min(lines)
                    yield from ((int(key[lo]), y, pivot) for y in lines if y != pivot)
                else:
                    yield from ((None, b, a) for a, b in combinations(sorted(lines), 2))

        yield from _batches(found())

    return meet.mapInArrow(groups, "key long, x long, pivot long").select(F.greatest("x", "pivot").alias("a"), F.least("x", "pivot").alias("b"), F.col("key").alias("hot"))


def line_texts(docs: DataFrame, wanted: DataFrame, min_bytes: int) -> DataFrame:
    """(h, line) of the lines with the digests `wanted` (h). Only these lines are moved: a hint
    sorts out most others first."""
    shared = hint(wanted)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, 2_000_000):
            own = {line_hash(line): line for text in batch.column(0).to_pylist() for _, line in eligible(text, min_bytes)}
            hashes, texts = np.fromiter(own, np.int64, len(own)), list(own.values())
            keep = np.flatnonzero(seen(shared.value, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array([texts[i] for i in keep.tolist()], pa.binary())], ["h", "line"])

    found = docs.where("doc_id is not null").select("text").mapInArrow(lines, "h long, line binary")
    return found.join(wanted.hint("merge"), "h", "left_semi").dropDuplicates(["h"])


def confirmed(pairs: DataFrame, lines: DataFrame, edits: int, share: int = 0) -> DataFrame:
    """The pairs of line digests whose lines are linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = [i for i in range(len(a)) if linked(x[i], y[i], edits, share)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    sides = [lines.select(F.col("h").alias(k), F.col("line").alias(v)).hint("merge") for k, v in (("a", "x"), ("b", "y"))]
    both = pairs.select("a", "b").distinct().join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


#: Kinds of words that are counted of a line.
KINDS = 256
#: Items before its own that a row of a prefix carries: a long line has a long prefix.
BEFORE = 64
#: Counts stop here, so that they, and differences of two, fit 16 bits. Cut counts are no further
#: apart than the full ones, so a test that they are near still loses no link.
MOST_COUNTED = (1 << 15) - 1


def counted(kinds: np.ndarray | list[int], n: int) -> np.ndarray:
    """How often each of the kinds 0 to n - 1 is among some, up to MOST_COUNTED."""
    return np.minimum(np.bincount(np.asarray(kinds, np.int64), minlength=n), MOST_COUNTED).astype(np.int16)


def with_bags(lines: DataFrame, share: int) -> DataFrame:
    """(node, n_bytes, bag, bytes_bag) from rows (node, line): the line's length, how many words of
    each of KINDS kinds it has (none without a share), and how often each byte (cut counts)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1_000_000):
            texts = batch.column(1).to_pylist()
            words = [counted([xxhash.xxh3_64_intdigest(w) % KINDS for w in x.split()] if share else [], KINDS) for x in texts]
            own = [counted(np.frombuffer(x, np.uint8), 256) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int32()), *(pa.array(x, pa.list_(pa.int16())) for x in (words, own))], ["node", "n_bytes", "bag", "bytes_bag"])

    return lines.select("node", "line").mapInArrow(bags, "node long, n_bytes int, bag array<smallint>, bytes_bag array<smallint>")


def line_items(texts: list[bytes], edits: int, size: int, hashes: WordHash) -> tuple[np.ndarray, list[tuple[bool, np.ndarray, np.ndarray]]]:
    """Each line's number of words, and (by words, number of the line, item) of all words of a line
    and, where it, or a line it may be linked to, has so few that edited bytes can change all of
    them, of all grams of `size` bytes. Equal ones of a line are told apart."""
    split = [x.split() for x in texts]
    words = np.array([len(x) for x in split], np.int64)
    of, own = np.repeat(np.arange(len(texts)), words), hashes.of([w for x in split for w in x])
    some, by_bytes = words[of] > 2 * edits, words <= 3 * edits
    parts = [(True, *numbered(of[some], own[some]))]
    chars = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    n = max(0, len(chars) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | chars[i : i + n]
    line = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    whole = (line[:n] == line[size - 1 : size - 1 + n]) & by_bytes[line[:n]]
    return words, [*parts, (False, *numbered(line[:n][whole], mixed(out[whole])))]


#: Slots of the counts of items: 4 MB, whatever the number of items.
COUNT_BITS = 20
#: Slots are dealt out over so many ranges when tasks' counts are added up; counts in a row.
RANGES, IN_ROW = 16, 2048


def item_counts(lines: DataFrame, edits: int, size: int) -> np.ndarray:
    """How many items of the lines (node, root, line) share each slot of a table of fixed size; 0 if
    all are of lines of one root. So a count is at least how often an item occurs, and the same
    wherever it does; with very many items it is larger, never smaller.

    A task counts its own lines' items first; packed counts move, not items.
    """
    slots = 1 << COUNT_BITS
    first, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    columns = "part int, slot array<int>, n array<bigint>, lo array<bigint>, hi array<bigint>"

    def empty() -> tuple[np.ndarray, ...]:
        return np.zeros(slots, np.int64), np.full(slots, last), np.full(slots, first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (n, lo, hi) = WordHash(), empty()
        for batch in sliced(batches, 2, 200_000):
            root = batch.column(1).to_numpy()
            for _, of, items in line_items(batch.column(2).to_pylist(), edits, size, hashes)[1]:
                slot = items.view(np.int64) & (slots - 1)
                np.add.at(n, slot, 1)
                np.minimum.at(lo, slot, root[of])
                np.maximum.at(hi, slot, root[of])
        used = np.flatnonzero(n)
        for part in range(RANGES):
            own = used[used * RANGES // slots == part]
            for k in range(0, len(own), IN_ROW):
                at = own[k : k + IN_ROW]
                packed = (pa.array([x]) for x in (at.astype(np.int32), n[at], lo[at], hi[at]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *packed], ["part", "slot", "n", "lo", "hi"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = empty()
        for batch in batches:
            for row in range(batch.num_rows):
                at, more, least, most = (batch.column(c)[row].values.to_numpy() for c in range(1, 5))
                n[at] += more
                lo[at] = np.minimum(lo[at], least)
                hi[at] = np.maximum(hi[at], most)
        at = np.flatnonzero(lo < hi)
        for k in range(0, len(at), IN_ROW):
            some = at[k : k + IN_ROW]
            df = np.minimum(n[some], (1 << 31) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([some.astype(np.int32)]), pa.array([df])], ["slot", "df"])

    own = lines.select("node", "root", "line").mapInArrow(count, columns)
    rows = own.repartition("part").mapInArrow(add, "slot array<int>, df array<int>").toArrow()
    table = np.zeros(slots, np.int32)
    for at, df in zip(rows.column("slot"), rows.column("df"), strict=True):
        table[at.values.to_numpy()] = df.values.to_numpy()
    return table


PREFIX = pa.schema([("item", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("by_words", pa.bool_()), ("n", pa.int32()), ("n_words", pa.int32()), ("m", pa.int32()), ("rank", pa.int32()), ("before", pa.list_(pa.int64()))])


def prefixes(lines: DataFrame, edits: int, share: int, size: int) -> DataFrame:
    """Rows of the items under which lines (node, root, line) must meet a line of another root that
    they may be linked to: those of a line's rarest that at most `allow` changed items leave one of.

    n is how many items of its kind (words or not) a line has, m how many of them lines of several
    roots have, rank the place of the item among those, and before the items just before it.
    """
    shared = lines.sparkSession.sparkContext.broadcast(item_counts(lines, edits, size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHash(), shared.value
        for batch in sliced(batches, 2, 200_000):
            node, root, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            words, parts = line_items(texts, edits, size, hashes)
            for kind, of, named in parts:
                # a line near the least length that allows word edits may be linked to a shorter one
                of_words = np.where(word_edits(words, share) > 0, np.where(word_edits(words - edits, share) > 0, 0, 2 * edits), 2 * edits)
                allow = np.maximum(word_edits(words, share), of_words) if kind else np.full(len(texts), edits * size)
                n = np.bincount(of, minlength=len(texts))
                item = named.view(np.int64)
                df = table[item & (len(table) - 1)]
                of, item, df = of[df > 0], item[df > 0], df[df > 0]
                m = np.bincount(of, minlength=len(texts))
                some = (m >= n - allow)[of]
                of, item, df = of[some], item[some], df[some]
                order = np.lexsort((item, df, of))
                of, item = of[order], item[order]
                rank = number_in_run(runs(of), len(of)) + 1
                early = rank + (n - m)[of] <= allow[of] + 1
                of, item, rank = of[early], item[early], rank[early]
                lengths = np.minimum(rank - 1, BEFORE)
                before = item[np.repeat(np.arange(len(of)) - lengths, lengths) + number_in_run((np.cumsum(lengths) - lengths)[lengths > 0], int(lengths.sum()))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(before, pa.int64()))
                counts = (pa.array(x.astype(np.int32)) for x in (n[of], words[of], m[of], rank))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(node[of]), pa.array(root[of]), pa.array(np.full(len(of), kind)), *counts, lists], schema=PREFIX)

    return lines.select("node", "root", "line").mapInArrow(cut, "item long, node long, root long, by_words boolean, n int, n_words int, m int, rank int, before array<bigint>")


def prefix_pairs(lines: DataFrame, edits: int, share: int, min_bytes: int) -> DataFrame:
    """Pairs (a > b) of the lines (node, root, line) of different roots that can still be linked:
    all that pass tests that no link fails.

    An edit of a word changes one word; one of a byte at most two, or as many grams of bytes as a
    gram is long. So two linked lines have all but `allow` of these items in common, one of the
    rarest allow + 1 of each among them (the prefix filter, in any one order of items; here by
    item_counts()); items that lines of one root alone have count for no one; and from the first
    common item on, in order of rarity, enough must be left. Most lines of a large family have so
    many changes of their own that they have no prefix at all. Counts of kinds of words, or bytes,
    must be near.
    """
    size = max(1, min(8, min_bytes // (2 * (edits + 1))))
    words_of = lambda n: F.greatest(F.floor(n * share / 100), F.lit(2))
    by_share = lambda n: F.floor(n * share / 100) > 0
    of_pair = lambda n: F.when(~F.col("by_words"), edits * size).when(by_share(n), words_of(n)).otherwise(2 * edits)
    prefix = written(prefixes(lines, edits, share, size), "prefix")
    split = prefix.groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("item")
    bags = with_bags(lines, share)
    prefix = prefix.join(split.hint("merge"), "item", "left_semi")
    prefix = written(prefix.join(bags.hint("merge"), "node"), "prefix")
    x, y = prefix.alias("x"), prefix.drop("by_words").alias("y")
    left = 1 + F.least(F.col("x.m") - F.col("x.rank"), F.col("y.m") - F.col("y.rank"))
    enough = left >= F.greatest("x.n", "y.n") - of_pair(F.least("x.n_words", "y.n_words"))
    both = (F.col("x.item") == F.col("y.item")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & enough
    # an edit changes two counts of bytes or words by one each, or one count by one
    differ = lambda c: F.aggregate(F.zip_with(f"x.{c}", f"y.{c}", lambda p, q: F.abs(p - q).cast("int")), F.lit(0), lambda a, d: a + d)
    least = F.least("x.n_words", "y.n_words")
    apart = lambda c: F.abs(F.col(f"x.{c}") - F.col(f"y.{c}"))
    by_words = F.col("by_words") & by_share(least)
    both &= F.when(by_words, apart("n_words") <= words_of(least)).otherwise(apart("n_bytes") <= edits) & ~F.arrays_overlap("x.before", "y.before")
    both &= F.when(by_words, differ("bag") <= 2 * words_of(least)).otherwise(differ("bytes_bag") <= 2 * edits)
    return x.join(y, both).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def unsettled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): lines of the large groups of pairs (a, b, hot) that lie in more than one
    component of roots (node, root).

    The pairs under a key connect all its lines, so these are in one component unless some pair is
    not. A pair under many keys is looked up once, and only groups that are apart are moved.
    """
    hot = pairs.where("hot is not null")
    root = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")).hint("merge")
    # the pairs under a key connect all its lines: these are in one component unless a pair is not
    met = hot.select("a", "b").distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    split = met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    open_ = written(hot.join(split.hint("merge"), ["a", "b"], "left_semi").select("hot").distinct(), "open")
    there = hot.join(open_.hint("merge"), "hot", "left_semi").select("a", "b").distinct()
    node = there.select(F.col("a").alias("node")).unionByName(there.select(F.col("b").alias("node"))).distinct()
    return node.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def line_classes(docs: DataFrame, edits: int, min_bytes: int, share: int = 0) -> DataFrame:
    """(node, root): digests of different lines that links connect.

    A large group is compared through one line first. Its lines that stay in different components
    may hold links that this did not show; they alone go through an exact prefix-filter join.
    """
    pairs = written(paired(keyed(docs, edits, min_bytes, share)), "pairs")
    lines = written(line_texts(docs, written(ends(pairs, "h"), "wanted"), min_bytes), "lines")
    links = written(confirmed(pairs, lines, edits, share), "links")
    roots = components(links)
    there = unsettled(pairs, roots)
    apart = written(there.join(lines.withColumnRenamed("h", "node").hint("merge"), "node"), "apart")
    more = prefix_pairs(apart, edits, share, min_bytes).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    found = written(confirmed(written(more, "pairs"), lines, edits, share), "links")
    return components(links.unionByName(found)) if found.limit(1).count() else roots


def line_decisions(docs: DataFrame, edits: int = 2, min_bytes: int = 60, share: int = 0, equal_bytes: int = 1) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line) of every line that repeats an earlier one.

    Lines are cut at LF. Those of at least equal_bytes (1 at least) UTF-8 bytes are compared for
    equality, those of at least min_bytes for links too; an empty line is never a row.
    Equal lines, and lines that a chain of links connects, are a class; its first line by
    (doc_id, line_no) stays and every other one is a row here. Two lines are linked if they are
    within `edits` edits of bytes. With a share, lines of so many words (between white space) that
    `share` (at most 10) in a hundred of the shorter one's are one or more, are linked instead if
    they are within as many edits of words, two at least.
    """
    places = written(occurrences(docs, max(1, equal_bytes)), "occurrences")
    roots = line_classes(docs, edits, min_bytes, share)
    place = F.struct("doc_id", "line_no")
    equal = places.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classed = equal.join(roots.withColumnRenamed("node", "h").hint("merge"), "h", "left")
    # a line without links is joined by its own digest, which is no root
    merged = classed.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    repeated = classed.where("n > 1 or root is not null").join(merged.withColumnRenamed("root", "of").hint("merge"), F.coalesce("root", "h") == F.col("of"), "left").select("h", "g", F.coalesce("least", "first").alias("first"))
    out = places.join(written(repeated, "repeated").hint("merge"), ["h", "g"])
    return out.where(F.struct("doc_id", "line_no") != F.col("first")).select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line")).distinct()


def line_report(docs: DataFrame, edits: int = 2, min_bytes: int = 60, share: int = 0, equal_bytes: int = 1) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_compared (lines of equal_bytes or more), n_removed,
    removed (line numbers from 0, ascending), class_docs (document of the line that stays, for
    each removed line). Lines are compared as in line_decisions().

    A null or empty text has no lines. Rows with a null doc_id are neither compared nor changed.
    Rows that share a doc_id are treated as one document, whose line k is any of their lines k.
    """
    gone = line_decisions(docs, edits, min_bytes, share, equal_bytes).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line_no", "class_doc"))).alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    compared = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.octet_length(x) >= max(1, equal_bytes))))
    base = docs.select("doc_id", F.when(text == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), compared.cast("long").alias("n_compared"))
    none = F.array().cast("array<struct<line_no:int,class_doc:bigint>>")
    return base.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "n_lines", "n_compared", F.size(F.coalesce("gone", none)).cast("long").alias("n_removed"), F.coalesce(F.col("gone.line_no"), F.array().cast("array<int>")).alias("removed"), F.coalesce(F.col("gone.class_doc"), F.array().cast("array<bigint>")).alias("class_docs"))


def line_deduplicated(docs: DataFrame, edits: int = 2, min_bytes: int = 60, share: int = 5, equal_bytes: int = 1) -> DataFrame:
    """docs with the repeated lines taken out of text (and n_chars, where there, counted anew).

    As line_decisions() has it, with edits of words besides. Every row stays, even if no line is
    left; all other columns stay as they are. A null or empty text stays; a row with a null doc_id
    is not changed; rows that share a doc_id are treated as one document, whose line k is any of
    their lines k. An empty table gives no rows.
    """
    gone_, doc_ = fresh(docs.columns, "gone", "doc")
    gone = line_decisions(docs, edits, min_bytes, share, equal_bytes).groupBy("doc_id").agg(F.collect_set("line_no").alias(gone_)).withColumnRenamed("doc_id", doc_)
    out = docs.join(gone.hint("merge"), F.col("doc_id") == F.col(doc_), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(gone_), i)), "\n")
    columns = {"text": F.when(F.col(gone_).isNotNull() & F.col("text").isNotNull(), kept).otherwise(F.col("text"))}
    out = out.withColumns(columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
