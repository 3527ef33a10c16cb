"""Exact Jaccard join of word n-gram sets by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, components, dropped, hint, mixed, seen, sliced, written
from .minhash import hinted_sets, shingle_set

#: A group of similar documents has about this many members and tokens; a larger family of
#: documents is dealt out over several groups.
MEMBERS, TOKENS = 32, 200_000
#: Groups that one task compares with a group.
QUERIES = 32
#: Coordinates of MinHash, each of which makes families of similar sets.
LEADS = 3
#: Tokens are counted in so many bins, each count up to BIN_MOST, to bound what two sets share.
BINS, BIN_MOST = 256, 255
#: Common tokens come last in the order of tokens; at most so many are known, from one text in
#: COMMON_OF. Which ones are known changes the cost of the join, not its links.
COMMON, COMMON_OF = 1_000_000, 16


def common_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Tokens that several of one different text in COMMON_OF hold, the most frequent, ascending."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches, 0, 500_000):
            own = [shingle_set(t, hashes, width) for t in batch.column(0).to_pylist()]
            g, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["token", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(COMMON_OF)) == 0).select("text").distinct()
    counts = some.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(got.column("token").to_numpy().view(np.uint64))


def least_common(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many tokens a set of n has in common with every set that it is linked to."""
    return -(-n * percent // 100)


def first_tokens(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The set's prefix in an order of all tokens, common ones last: two linked sets both have one
    token, at least, among theirs."""
    n = len(tokens)
    size = n - least_common(n, percent) + 1
    late = np.zeros(n, bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
    return np.concatenate([tokens[~late][:size], tokens[late]])[:size]


def binned(tokens: np.ndarray) -> bytes:
    """How many tokens of a set fall in each bin, one byte a bin."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=BINS), BIN_MOST).astype(np.uint8).tobytes()


def most_shared(n: np.ndarray, bins: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Row by row, no set with the bins `others` shares more tokens than this with a set of n tokens
    that has `bins`. What was cut off from a bin's count may all be shared."""
    return np.minimum(bins, others).sum(1, dtype=np.int64) + n - bins.sum(1, dtype=np.int64)


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def described(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, leads, prefix, bins): set size, 128-bit digest of the set,
    LEADS coordinates of MinHash, the prefix and counts of tokens."""
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches, 1, 1_000_000):
            sets = [shingle_set(t, hashes, width) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            out, leads = np.zeros((2, len(sets)), np.uint64), np.zeros((len(sets), LEADS), np.uint64)
            if len(full):
                flat, at = np.concatenate([sets[i] for i in full]), np.cumsum(np.concatenate([[0], n[full][:-1]]))
                least = [np.minimum.reduceat(mixed(flat ^ np.uint64(seed)), at) for seed in range(1, LEADS + 1)]
                for k in range(LEADS):
                    leads[full, k] = mixed(least[k] + np.uint64(k))
                out[:, full] = np.add.reduceat(mixed(flat), at), np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
            prefix = [first_tokens(s, common.value, percent).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(pa.array(x.view(np.int64)) for x in out), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LEADS), pa.array(leads.view(np.int64).ravel())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix))), pa.array([binned(s) for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "leads", "prefix", "bins"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(describe, "doc_id long, n_shingles long, set_a long, set_b long, leads array<long>, prefix array<long>, bins binary")


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without making Python numbers of them."""
    return np.split(column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))[:-1])


MATRIX = "g long, members array<long>, roots array<long>, sizes array<int>, tokens array<long>, places array<int>"


def matrix_of(sets: DataFrame) -> DataFrame:
    """One row for each group of rows (g, doc_id, root, shingles): the union of its members' tokens,
    ascending, and where in it the tokens of each member lie."""

    def gather(group: pa.Table) -> pa.Table:
        lists = group.column("shingles").combine_chunks()
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)
        union, places = np.unique(flat, return_inverse=True)
        row = [group.column("g")[0].as_py(), group.column("doc_id").to_pylist(), group.column("root").to_pylist(), sizes.astype(np.int32), union.view(np.int64), places.astype(np.int32)]
        return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in MATRIX.split(", ")]
    return sets.select("g", "doc_id", "root", "shingles").groupBy("g").applyInArrow(gather, MATRIX)


def links_within(matrix: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the members of each group as all links among them do."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members, n, tokens, places in zip(*(lists_of(batch.column(c)) for c in ("members", "sizes", "tokens", "places")), strict=True):
                at, root = np.concatenate([[0], np.cumsum(n)]), np.arange(len(n))
                for i in range(1, len(n)):
                    mine = np.zeros(len(tokens), bool)
                    mine[places[at[i] : at[i + 1]]] = True
                    same = np.add.reduceat(mine[places[: at[i]]].astype(np.int64), at[:i])
                    for r in np.unique(root[:i][same * (100 + percent) >= (n[:i].astype(np.int64) + n[i]) * percent]).tolist():
                        a.append(members[i])
                        b.append(members[r])
                        root[root == root[r]] = root[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return matrix.mapInArrow(link, "a long, b long")


def may_open(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The pairs of groups (g, of) some of whose members can be linked by the counts in their bins.
    A group's bins hold the largest count of any member."""

    def widest(group: pa.Table) -> pa.Table:
        n = group.column("n").to_pylist()
        row = [group.column("g")[0].as_py(), min(n), max(n), sum(n), rows_of(group.column("bins").combine_chunks()).max(0).tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["g", "least", "most", "tokens", "bins"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least_x, least_y, most_x, most_y = (batch.column(i).to_numpy() for i in range(2, 6))
            least, most = np.maximum(least_x, least_y), np.minimum(most_x, most_y)
            x, y = rows_of(batch.column(6)), rows_of(batch.column(7))
            # counts cut off in both may be shared: no more of them than a member has
            cut = np.where(((x == BIN_MOST) & (y == BIN_MOST)).any(1), most, 0)
            yield batch.select([0, 1]).filter(pa.array(np.minimum(x, y).sum(1, dtype=np.int64) + cut >= least_common(least, percent)))

    asked = pairs.select(F.explode(F.array("g", "of")).alias("g")).distinct()
    groups = placed.join(asked.hint("merge"), "g", "left_semi").select("g", "n", "bins").groupBy("g").applyInArrow(widest, "g long, least long, most long, tokens long, bins binary")
    groups = written(groups, "bins")
    one, two = (groups.toDF(k, *(f"{c}_{k}" for c in ("least", "most", "tokens", "bins"))) for k in ("g", "of"))
    both = pairs.join(one.hint("merge"), "g").join(two.hint("merge"), "of")
    # the group with fewer tokens is moved to the other
    less = F.col("tokens_g") <= F.col("tokens_of")
    both = both.select(F.when(less, F.col("g")).otherwise(F.col("of")).alias("x"), F.when(less, F.col("of")).otherwise(F.col("g")).alias("y"), "least_g", "least_of", "most_g", "most_of", "bins_g", "bins_of")
    return both.mapInArrow(bound, "x long, y long").toDF("g", "of")


def links_across(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members, with different roots, of the pairs of groups (g, of). Every
    member of g is a query: only if the union of all tokens of `of` has least_common() of its tokens
    are the members of `of` looked at. A group that many ask is dealt out, with them, over several
    tasks."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        names = ("members", "roots", "sizes", "tokens", "places")
        members, roots, n, union, places = (lists_of(right.column(c).combine_chunks())[0] for c in names)
        union, at = union.view(np.uint64), np.concatenate([[0], np.cumsum(n)[:-1]])
        for batch in left.select(names).to_batches():
            for asking_, own_roots, sizes, tokens, own_places in zip(*map(lists_of, batch.columns), strict=True):
                where = np.minimum(np.searchsorted(union, tokens.view(np.uint64)), len(union) - 1)
                where = np.where(union[where] == tokens.view(np.uint64), where, -1)
                for doc_id, root, own in zip(asking_.tolist(), own_roots.tolist(), np.split(where[own_places], np.cumsum(sizes)[:-1]), strict=True):
                    held = own[own >= 0]
                    if len(held) < least_common(len(own), percent):
                        continue
                    mine = np.zeros(len(union), np.int64)
                    mine[held] = 1
                    same = np.add.reduceat(mine[places], at)
                    linked = (same * (100 + percent) >= (n.astype(np.int64) + len(own)) * percent) & (roots != root)
                    _, first = np.unique(roots[linked], return_index=True)
                    for i in np.flatnonzero(linked)[first].tolist():
                        a.append(doc_id)
                        b.append(members[i])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    tasks = pairs.groupBy("of").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks"))
    left = pairs.join(tasks.hint("merge"), "of").withColumn("part", F.pmod(F.xxhash64("g"), F.col("tasks")).cast("int")).join(matrix.hint("merge"), "g").drop("tasks")
    right = matrix.select(F.col("g").alias("of"), *(F.col(c).alias(c) for c in matrix.columns[1:])).join(tasks.hint("merge"), "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    return left.groupBy("of", "part").cogroup(right.drop("tasks").groupBy("of", "part")).applyInArrow(compare, "a long, b long")


def grouped(classes: DataFrame, percent: int) -> DataFrame:
    """(rep, g, own): the groups of similar sets; of a set's groups, one is its own.

    Sets with an equal coordinate of MinHash, as two similar sets have with a probability of their
    similarity, are a family. Its pivot is a set whose coordinates most of them have; those that
    may be linked to it, by the counts in their bins, are dealt out over groups of about MEMBERS
    sets by a digest, and the pivot joins all of these. Any other set is no member of a group here.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            shared = np.minimum(most_shared(n, rows_of(batch.column(3)), rows_of(batch.column(6))), np.minimum(n, m))
            some = shared * (100 + percent) >= (n + m) * percent
            yield batch.select([0, 1, 2, 4]).filter(pa.array(some))

    led = classes.select("rep", F.explode("leads").alias("lead"))
    several = led.groupBy("lead").agg(F.count("*").alias("sets")).where("sets > 1").select("lead")
    some = led.join(several.hint("merge"), "lead", "left_semi").join(classes.select("rep", "n", F.xxhash64("leads").alias("form"), "bins").hint("merge"), "rep")
    forms = some.groupBy("lead", "form").agg(F.count("*").alias("sets"), F.min(F.struct("rep", "n", "bins")).alias("p"))
    pivots = forms.groupBy("lead").agg(F.max_by("p", F.struct("sets", -F.col("p.rep"))).alias("p")).select("lead", F.col("p.rep").alias("pivot"), F.col("p.n").alias("m"), F.col("p.bins").alias("others"))
    both = some.drop("form").join(pivots.hint("merge"), "lead").select("rep", "n", "lead", "bins", "pivot", "m", "others")
    close = written(both.mapInArrow(near, "rep long, n long, lead long, pivot long"), "families")
    parts = close.groupBy("lead", "pivot").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where("sets > 1")
    parts = parts.select("lead", "pivot", F.ceil(F.greatest(F.col("sets") / MEMBERS, F.col("tokens") / TOKENS)).alias("parts"))
    own = close.select("rep", "lead").join(parts.hint("merge"), "lead").select("rep", F.xxhash64("lead", F.pmod(F.xxhash64("rep"), "parts")).alias("g"), F.lit(True).alias("own"))
    guests = parts.where("parts > 1").select(F.col("pivot").alias("rep"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.xxhash64("lead", k))).alias("g"), F.lit(False).alias("own"))
    return own.union(guests).groupBy("rep", "g").agg(F.max("own").alias("own"))


def asking(placed: DataFrame, shared: DataFrame) -> DataFrame:
    """(g, loose, root, n, token): the tokens of prefixes that are in the one column of `shared`. A
    hint sorts out most others before any are moved."""
    bitmap = hint(shared)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = seen(bitmap.value, flat)
            rows = pa.array(np.repeat(np.arange(len(batch)), sizes)[keep])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(4)), pa.array(flat[keep])], ["g", "loose", "root", "n", "token"])

    rows = placed.select("g", "loose", "root", "n", "prefix").mapInArrow(tokens, "g long, loose boolean, root long, n long, token long")
    return rows.join(shared.hint("merge"), "token", "left_semi")


def similar_sets(docs: DataFrame, percent: int = 80, width: int = 3) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of percent/100.

    Returns for each row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by
    links). Rows with the same doc_id are one node. A document without words, or with a null text,
    is linked to nothing; a null doc_id has a null component. An empty table gives no rows; extra
    columns are not read.

    Equal sets fold into one. Similar sets are partitioned into groups (grouped()) and compared
    there; links make components. A token-group matrix then finds the links between groups: groups
    meet under tokens that several components hold, if the token is in the prefix of some member of
    each. Counts of tokens in bins rule most of these meetings out before sets are moved, and a
    query opens a group only if the union of all its tokens holds enough of the query's. All tests
    pass every link, so none is lost. What lies in one component is not compared again.
    """
    described_ = written(described(docs, percent, width), "described")
    base = written(described_.select("doc_id", "n_shingles", "set_a", "set_b"), "sets")
    filled = base.where("doc_id is not null and n_shingles > 0")
    one = described_.where("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c if c != "n_shingles" else "n") for c in ("n_shingles", "leads", "prefix", "bins")))
    classes = written(one, "classes")
    dropped(described_)
    members = written(grouped(classes, percent), "groups")
    sets = hinted_sets(docs, members.select(F.col("rep").alias("doc_id")).distinct(), width).withColumnRenamed("doc_id", "rep")
    inside = members.select("rep", "g").join(sets.hint("merge"), "rep").select("g", F.col("rep").alias("doc_id"), F.col("rep").alias("root"), "shingles")
    # a document of several rows with different sets links them
    several = filled.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("lo"), F.max(F.struct("set_a", "set_b")).alias("hi")).where("lo <> hi")
    of_several = filled.join(several.select("doc_id").hint("merge"), "doc_id", "left_semi").join(classes.select("set_a", "set_b", "rep").hint("merge"), ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    same = of_several.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = written(links_within(matrix_of(inside), percent).union(same), "links")
    roots = components(links)

    placed = classes.join(members.where("own").groupBy("rep").agg(F.min("g").alias("g")).hint("merge"), "rep", "left").join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    # of the sets without a group, larger families with two equal coordinates make groups too
    lead = F.xxhash64(F.col("leads")[0], F.col("leads")[1])
    alone = placed.where("g is null").groupBy(lead.alias("lead")).agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where(F.col("sets") > MEMBERS // 4)
    alone = alone.select("lead", F.ceil(F.greatest(F.col("sets") / MEMBERS, F.col("tokens") / TOKENS)).alias("parts"))
    placed = placed.join(alone.hint("merge"), F.col("g").isNull() & (lead == F.col("lead")), "left")
    placed = written(placed.select("rep", "n", "prefix", "bins", F.coalesce("g", F.when(F.col("lead").isNotNull(), F.xxhash64(F.col("lead"), F.lit("alone"), F.pmod(F.xxhash64("rep"), "parts"))), F.xxhash64("rep", F.lit("alone"))).alias("g"), F.col("g").isNull().alias("loose"), F.coalesce("root", "rep").alias("root")), "placed")
    reps = written(classes.select("set_a", "set_b", "rep"), "reps")
    dropped(classes)
    tokens = placed.select("root", F.explode("prefix").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token"), "shared")
    tokens = written(asking(placed, shared), "tokens")
    index = written(tokens.groupBy("token", "g").agg(F.max("loose").alias("loose"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")), "index")
    x, y = index.alias("x"), index.alias("y")
    # the members of a group with a pivot are compared already
    asks = (F.col("x.g") < F.col("y.g")) | (F.col("x.g") == F.col("y.g")) & F.col("x.loose")
    asks &= (F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi")) & (F.col("x.most") * 100 >= F.col("y.least") * percent) & (F.col("y.most") * 100 >= F.col("x.least") * percent)
    pairs = written(x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & asks).select(F.col("x.g").alias("g"), F.col("y.g").alias("of")).distinct(), "pairs")
    pairs = written(may_open(pairs, placed, percent), "may_open")
    if not pairs.isEmpty():
        opened = written(placed.select("rep", "g", "root").join(pairs.select(F.explode(F.array("g", "of")).alias("g")).distinct().hint("merge"), "g", "left_semi"), "opened")
        sets = hinted_sets(docs, opened.select(F.col("rep").alias("doc_id")), width).withColumnRenamed("doc_id", "rep")
        matrix = written(matrix_of(opened.join(sets.hint("merge"), "rep").select("g", F.col("rep").alias("doc_id"), "root", "shingles")), "matrix")
        found = written(links_across(pairs, matrix, percent), "links")
        if not found.isEmpty():
            roots = components(links.union(found))
    rooted = reps.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("component"))
    out = base.join(rooted.hint("merge"), ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
