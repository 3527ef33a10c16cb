"""Operators over commits, changed files and line ownership; all relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_generated, is_test_path
from ..storage import dealt, stored

DAY = 86_400


def file_frequencies(commit_files: DataFrame, commits: DataFrame, since: Column | None = None) -> DataFrame:
    """(path, commits, first_ts, last_ts) over commits with at most one parent."""
    kept = commits.where("n_parents <= 1")
    kept = kept if since is None else kept.where(F.col("ts") >= since)
    return commit_files.join(kept.select("commit_id", "ts"), "commit_id").groupBy("path").agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def recent_authors(commits: DataFrame, since: Column) -> DataFrame:
    return commits.where((F.col("n_parents") <= 1) & (F.col("ts") >= since)).select("email").distinct()


def churn(freq: DataFrame) -> DataFrame:
    """Adds rate_per_month over months of 30 days (one at least) and its level."""
    months = F.greatest((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / (30.0 * DAY), F.lit(1.0))
    rate = F.col("commits") / months
    return freq.withColumn("rate_per_month", rate).withColumn("level", F.when(rate > 4, "HIGH").when(rate >= 1, "MEDIUM").otherwise("LOW"))


def age(freq: DataFrame, now: Column, active: int = 90, frozen: int = 365) -> DataFrame:
    """Days since the last change, never negative, and the status."""
    if active >= frozen:
        raise ValueError("active days must be fewer than frozen days")
    days = F.floor(F.greatest(F.unix_timestamp(now) - F.unix_timestamp("last_ts"), F.lit(0)) / DAY)
    return freq.select("path", "last_ts", days.alias("age_days")).withColumn("status", F.when(F.col("age_days") < active, "ACTIVE").when(F.col("age_days") < frozen, "STALE").otherwise("FROZEN"))


def never_changed(files: DataFrame, freq: DataFrame) -> DataFrame:
    """Files that no commit has: age() has no row for them."""
    return files.join(freq, "path", "left_anti")


def hotspots(complexity: DataFrame, freq: DataFrame) -> DataFrame:
    """(path, commits, complexity, score) of files with both."""
    return complexity.join(freq.select("path", "commits"), "path").withColumn("score", F.col("commits") * F.col("complexity"))


#: Files of a commit that are paired at a time.
BLOCK = 1_000


def paired(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(commit_id, x, y): every two files of a commit, once each, from rows (commit_id, file).

    A commit of more than `block` files is dealt out over blocks by a digest, and its pairs over the
    cells of a triangular grid of blocks: a cell pairs two blocks, so no task holds more than these,
    however large the commit.
    """
    sizes = changes.groupBy("commit_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = stored(changes.join(sizes, "commit_id").withColumn("own", F.pmod(F.xxhash64("file"), "blocks").cast("int")), "own")
    n = own.agg(F.sum("blocks")).first()[0] or 0
    rows = own.select("commit_id", "own", F.col("file").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("other"))
    columns = own.select("commit_id", F.col("own").alias("other"), F.col("file").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("own"))
    cell = ["commit_id", "own", "other"]
    return dealt(rows, n, *cell).join(dealt(columns, n, *cell), cell).where("own < other or x < y").select("commit_id", "x", "y")


def temporal_coupling(commit_files: DataFrame, freq: DataFrame, min_degree: int = 3, min_strength: float = 0.0, keep_tests: bool = True, block: int = BLOCK) -> DataFrame:
    """Pairs of files changed together; only files with min_degree commits are paired and, unless
    keep_tests, no tests. Commits of any size count (paired())."""
    if min_degree < 1:
        raise ValueError("min_degree must be positive")
    busy = freq.where(F.col("commits") >= min_degree).select("path", "commits")
    busy = busy if keep_tests else busy.where(~is_test_path(F.col("path")))
    # the count travels with the change, so the pair needs no second look-up
    kept = stored(commit_files.select("commit_id", "path").join(busy.hint("shuffle_hash"), "path").select("commit_id", F.struct("path", "commits").alias("file")), "changes")
    changes = dealt(kept, kept.count(), "commit_id")
    several = changes.groupBy("commit_id").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    a, b = F.least("x", "y"), F.greatest("x", "y")
    each = paired(changes, block).select(a["path"].alias("file_a"), b["path"].alias("file_b"), a["commits"].alias("commits_a"), b["commits"].alias("commits_b"))
    pairs = dealt(each, several, "file_a", "file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("shared_commits"), F.first("commits_a").alias("commits_a"), F.first("commits_b").alias("commits_b"))
    strength = F.col("shared_commits") / F.least("commits_a", "commits_b")
    level_ = F.when(F.col("strength") >= 0.5, "STRONG").when(F.col("strength") >= 0.3, "MODERATE").otherwise("WEAK")
    return pairs.withColumn("strength", strength).where(F.col("strength") >= min_strength).withColumn("level", level_)


def blame_summary(hunks: DataFrame) -> DataFrame:
    """(path, author, email, lines, last_ts) from ownership hunks."""
    return hunks.groupBy("path", "author", "email").agg(F.sum("n_lines").alias("lines"), F.max("ts").alias("last_ts"))


def ownership(blame: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """Primary owner, share, contributors and risk of each file; ties go to the lesser name.

    knowledge_loss: the owner is not among the recent authors (email), and there are any.
    """
    order = Window.partitionBy("path").orderBy(F.desc("lines"), "author", "email")
    ranked = blame.withColumn("rank", F.row_number().over(order))
    out = ranked.groupBy("path").agg(
        F.sum("lines").alias("total_lines"),
        F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("primary_owner"),
        F.max(F.when(F.col("rank") == 1, F.col("email"))).alias("primary_email"),
        F.max("lines").alias("top"),
        F.sum(F.when(F.col("rank") <= 3, F.col("lines"))).alias("top3"),
        F.count("*").alias("contributors"),
    )
    pct, pct3 = F.col("top") * 100.0 / F.col("total_lines"), F.col("top3") * 100.0 / F.col("total_lines")
    out = out.withColumn("ownership_pct", pct).withColumn("risk", F.when(pct >= 80, "CRITICAL").when(pct >= 60, "HIGH").when(pct3 >= 80, "MEDIUM").otherwise("LOW")).drop("top", "top3")
    if recent is None:
        return out.withColumn("knowledge_loss", F.lit(False))
    known = recent.select(F.col("email").alias("primary_email")).distinct().withColumn("_recent", F.lit(True))
    some = recent.agg((F.count("*") > 0).alias("_some"))
    return out.join(known, "primary_email", "left").join(F.broadcast(some)).withColumn("knowledge_loss", F.col("_some") & F.col("_recent").isNull()).drop("_recent", "_some")


def knowledge(blame: DataFrame, recent: DataFrame | None = None, author: str | None = None, risk_only: bool = False) -> DataFrame:
    """Ownership of files that no tool wrote; of one author (part of the name or e-mail of the
    primary owner, in any case), or only files whose owner is not recent."""
    out = ownership(blame.where(~is_generated(F.col("path"))), recent)
    if author:
        has = lambda c: F.lower(c).contains(author.lower())
        out = out.where(has(F.col("primary_owner")) | has(F.col("primary_email")))
    return out.where("knowledge_loss") if risk_only else out


#: Orders of the knowledge report.
KNOWLEDGE_ORDERS = {"concentration": (F.desc, "ownership_pct"), "diffusion": (F.desc, "contributors"), "risk": (F.asc, "risk_rank")}


def ordered_knowledge(owned: DataFrame, by: str = "concentration", top: int = 20) -> DataFrame:
    """A report of `top` files."""
    direction, column = KNOWLEDGE_ORDERS[by]
    ranked = owned.withColumn("risk_rank", F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk")))
    return ranked.orderBy(direction(column), "path").limit(top).drop("risk_rank")


RISKS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def ownership_by_author(owned: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Per primary owner: files, lines, worst risk, files whose knowledge is lost and, with the
    languages of files (path, language), these, sorted."""
    if languages is not None:
        by = owned.join(languages, "path").groupBy(F.col("primary_owner").alias("author")).agg(F.array_sort(F.collect_set("language")).alias("languages"))
        return ownership_by_author(owned).join(by, "author", "left")
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    return owned.groupBy(F.col("primary_owner").alias("author")).agg(F.count("*").alias("files_owned"), F.sum("total_lines").alias("total_lines"), F.element_at(F.array(*map(F.lit, RISKS)), F.min(rank).cast("int")).alias("worst_risk"), F.sum(F.col("knowledge_loss").cast("long")).alias("knowledge_loss_files"))


def bus_factor(blame: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Authors by lines with cumulative shares; critical while the share before is under the
    threshold. Authors are ranged over partitions by lines, each part sums its own, and the sums
    of the parts before are added, so no task sees all authors."""
    by = blame.groupBy("author").agg(F.sum("lines").alias("lines"))
    ranged = by.repartitionByRange(F.desc("lines"), F.col("author")).withColumn("part", F.spark_partition_id())
    parts = ranged.groupBy("part").agg(F.sum("lines").alias("own"))
    # one row per part: few, whatever the number of authors
    order = Window.orderBy("part")
    before = parts.select("part", (F.sum("own").over(order) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(F.desc("lines"), "author")
    out = ranged.withColumn("cumulative", F.sum("lines").over(within)).join(F.broadcast(before), "part").withColumn("cumulative", F.col("cumulative") + F.col("before"))
    pct = lambda x: x * 100.0 / F.col("total")
    return out.select("author", "lines", pct(F.col("lines")).alias("pct"), pct(F.col("cumulative")).alias("cumulative_pct"), (pct(F.col("cumulative") - F.col("lines")) < threshold).alias("is_critical"))


def authors(blame: DataFrame, languages: DataFrame, since: Column | None = None) -> DataFrame:
    """Per email: lines, languages, last activity and files of which they own most lines; with
    `since`, of the ownership rows last changed from then on only. Rows are dealt out by their
    number, by path and then by email, as the lists of languages are sorted row by row."""
    blame = stored(blame if since is None else blame.where(F.col("last_ts") >= since), "blame")
    n = blame.count()
    order = Window.partitionBy("path").orderBy(F.desc("lines"), "author", "email")
    top = dealt(blame, n, "path").withColumn("owner", F.first("email").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return dealt(top.join(languages, "path", "left"), n, "email").groupBy("email").agg(F.max("author").alias("name"), F.sum("lines").alias("lines"), F.array_sort(F.collect_set("language")).alias("languages"), F.max("last_ts").alias("last_active"), F.sum((F.col("owner") == F.col("email")).cast("long")).alias("owned_files"))


def dependency_fan(edges: DataFrame) -> DataFrame:
    """(file, fan_in, fan_out) of the distinct edges (src, dst)."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.file").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def files_changed_since(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of `new` (path, content_hash) that `old` lacks or has with another hash."""
    return new.join(old.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path")


def cycles(edges: DataFrame) -> DataFrame:
    """(file, cycle): the files on a cycle of edges (src, dst), and the least file of their cycle.

    A file that names itself is no cycle. Files with a single way on are followed by pointers that
    double their reach each round, so chains and rings take rounds in the logarithm of their length
    (bypassed()); what then has several ways in and on everywhere is left to labels that spread
    (spread_cycles()). Tables of the rounds are written to the shared folder.
    """
    labels = bypassed(stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges"), True, False)
    least = labels.groupBy("label").agg(F.min("file").alias("cycle"))
    return labels.join(least, "label").select("file", "cycle")


def bypassed(e: DataFrame, onward: bool, idle: bool) -> DataFrame:
    """(file, label) of the files on cycles, after those with one way on (or, if not onward, one
    way in) are bypassed.

    Each of them leads to a ring of such files, which is a cycle of its own, or to an end: a file
    with no way on, so that none of them is on a cycle, or one with several. Edges to the latter's
    followers are led to it, and the rest is solved alone, with the other direction. A bypassed
    file is on its end's cycle if a file of that cycle leads to it or to one before it.
    """
    a, b = ("src", "dst") if onward else ("dst", "src")
    none = e.select(F.col("src").alias("file"), F.col("src").alias("label")).limit(0)
    if e.isEmpty():
        return none
    ways = e.groupBy(F.col(a).alias("file")).agg(F.count("*").alias("n"), F.min(b).alias("next"))
    one = stored(ways.where("n = 1").select("file", "next"), "single")
    ends = e.select(F.col(b).alias("file")).join(ways, "file", "left_anti")
    left = one.count()
    if not left and ends.isEmpty():
        return spread_cycles(e) if idle else bypassed(e, not onward, True)

    reach = [one]
    table = stored(one.select("file", "next", F.col("file").alias("least")), "reach")
    step = 1
    while step < left and not table.join(one.select(F.col("file").alias("next")), "next", "left_semi").isEmpty():
        on = table.select(F.col("file").alias("next"), F.col("next").alias("further"), F.col("least").alias("also"))
        table = stored(table.join(on, "next", "left").select("file", F.coalesce("further", "next").alias("next"), F.least("least", "also").alias("least")), "reach")
        reach.append(table.select("file", "next"))
        step *= 2
    ring = table.select(F.col("next").alias("file")).distinct().join(table.select("file", F.col("least").alias("label")), "file")
    several = ways.where("n > 1").select("file")
    end = stored(table.select("file", F.col("next").alias("end")).join(several.withColumnRenamed("file", "end"), "end", "left_semi").unionByName(several.select("file", F.col("file").alias("end"))), "ends")
    # edges of files with several ways on, to where they lead in the end
    led = stored(e.join(several.withColumnRenamed("file", a), a, "left_semi").select(F.col(a).alias("from"), F.col(b).alias("file")).join(end, "file"), "led")
    rest = stored(led.where(F.col("from") != F.col("end")).select(F.col("from").alias(a), F.col("end").alias(b)).distinct(), "edges")
    labels = bypassed(rest, not onward, False)
    alone = led.where(F.col("from") == F.col("end")).select(F.col("from").alias("file")).distinct().join(labels, "file", "left_anti")
    labels = stored(labels.unionByName(alone.select("file", F.col("file").alias("label"))), "labels")
    entered = led.where(F.col("file") != F.col("end")).join(labels.select(F.col("file").alias("from"), "label"), "from").join(labels.select(F.col("file").alias("end"), F.col("label").alias("of")), "end").where("label = of")
    marked = stored(entered.select("file", "label").distinct(), "marked")
    for pointers in reach if not marked.isEmpty() else ():
        further = marked.join(pointers, "file").select(F.col("next").alias("file"), "label")
        marked = stored(marked.unionByName(further.join(one.select("file"), "file", "left_semi")).distinct(), "marked")
    return labels.unionByName(marked).unionByName(ring)


def spread_cycles(e: DataFrame) -> DataFrame:
    """(file, label) of the files on cycles: every file's forward and backward least reachable file
    is spread until nothing changes; where the two agree, that is its cycle. The others go on
    without the edges between different labels."""

    def spread(nodes: DataFrame, a: str, b: str) -> DataFrame:
        """The least file that reaches each file along a -> b."""
        label = stored(nodes.select("file", F.col("file").alias("m")), "least")
        while True:
            sent = e.join(label.withColumnRenamed("file", a), a).select(F.col(b).alias("file"), "m")
            new = stored(label.unionByName(sent).groupBy("file").agg(F.min("m").alias("m")), "least")
            changed = not new.join(label.withColumnRenamed("m", "old"), "file").where("m <> old").isEmpty()
            label = new
            if not changed:
                return label

    nodes = e.select(F.explode(F.array("src", "dst")).alias("file")).distinct()
    both = stored(spread(nodes, "src", "dst").join(spread(nodes, "dst", "src").withColumnRenamed("m", "back"), "file"), "both")
    sizes = both.where("m = back").groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    found = both.where("m = back").join(sizes, "m", "left_semi").select("file", F.col("m").alias("label"))
    rest = both.where("m <> back").select("file", F.struct("m", "back").alias("label"))
    inside = e.join(rest.select(F.col("file").alias("src"), F.col("label").alias("x")), "src").join(rest.select(F.col("file").alias("dst"), F.col("label").alias("y")), "dst").where("x = y").select("src", "dst")
    return found.unionByName(bypassed(stored(inside, "edges"), True, False))
