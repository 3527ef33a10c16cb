"""URL filter: host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    l2: float = 1.0
    max_train: int = 20_000  #: bound on the labelled URLs whose features come to the driver
    max_suffixes: int = 500  #: suffixes whose statistics go along as literals; those of all others are joined
    prior: float = 20.0  #: weight of the overall rate in a suffix's rate


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule `host/path` that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, rest = pattern.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.char_length(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    chars = F.split(url, "")
    share = lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "length": n,
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "digits": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("[^&]+"))),
        "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, "\\."))),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
    }


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def column(self, x: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.cut, self.low.column(x)).otherwise(self.high.column(x))

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.apply(x), self.high.apply(x))


def grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, s: Settings) -> Tree:
    """The tree with the best second-order gain at each node, from histograms of the bins."""
    leaf = Tree(value=float(-s.rate * g.sum() / (h.sum() + s.l2)))
    if not depth or len(g) < 2:
        return leaf
    best = (1e-6, -1, 0.0)
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        b = np.searchsorted(at, x[:, f], side="left")
        gl, hl = np.cumsum(np.bincount(b, g, len(at) + 1))[:-1], np.cumsum(np.bincount(b, h, len(at) + 1))[:-1]
        gain = gl**2 / (hl + s.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + s.l2) - g.sum() ** 2 / (h.sum() + s.l2)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(at[k]))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[low], cuts, g[low], h[low], depth - 1, s), grow(x[~low], cuts, g[~low], h[~low], depth - 1, s))


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, list[Tree]]:
    """(start, trees) of the log odds of label 1; without both labels, no trees."""
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not 0 < y.sum() < len(y):
        return start, []
    cuts = [np.unique(np.quantile(c, np.arange(1, s.bins) / s.bins, method="lower")) for c in x.T]
    cuts = [c[c < x[:, i].max()] for i, c in enumerate(cuts)]
    z, trees = np.full(len(y), start), []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(x, cuts, p - y, p * (1 - p), s.depth, s))
        z += trees[-1].apply(x)
    return start, trees


def judged(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """A verdict for every row of pages (page_id, url): page_id, host, path, rule, verdict, block_odds.

    The longest rule that fits decides; else the trees do (block from even odds on). They are
    fitted to labels (url, blocked 0/1) or, without labels, to the URLs that a rule decides, at
    most s.max_train of them. Scoring is one expression; only the bounded sample's features come
    to the driver. A null url, or one without ://, has an empty host and path and is judged by
    the trees. Without labelled URLs every other verdict is allow. Equal rows of
    labels count once. Extra columns are not read.
    """
    base = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("says", says).withColumn("suffix", suffix_of(F.col("host")))
    if labels is None:
        key = ["page_id"]
        known = base.where("says is not null").withColumn("y", (F.col("says") == "block").cast("int"))
    else:
        key = []
        known = labels.select("url", F.col("blocked").cast("int").alias("y")).where("url is not null and y in (0, 1)").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("suffix", suffix_of(F.col("host")))
    counts = written(known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("bad")), "suffixes")
    sums = counts.agg(F.count("*").alias("suffixes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    most = [(r["suffix"], r["n"], r["bad"]) for r in counts.orderBy(F.desc("n"), "suffix").limit(s.max_suffixes).collect()]
    overall = (sums["bad"] + 0.5) / (sums["n"] + 1)
    rates = {x: ((b + s.prior * overall) / (n + s.prior), float(np.log1p(n))) for x, n, b in most}
    as_map = lambda i: F.create_map(*(F.lit(v) for x, r in rates.items() for v in (x, r[i]))) if rates else None
    hot = lambda i: F.try_element_at(as_map(i), F.col("suffix")) if rates else F.lit(None).cast("double")
    few = sums["suffixes"] <= len(most)
    if not few:
        rate = (F.col("bad") + s.prior * overall) / (F.col("n") + s.prior)
        others = counts.where(hot(0).isNull()).select(F.col("suffix").alias("_suffix"), rate.alias("_rate"), F.log1p(F.col("n").cast("double")).alias("_seen"))

        def with_rates(df: DataFrame, *own: str) -> DataFrame:
            # rows of the most frequent suffixes need no partner: they are dealt out by their own hash
            apart = F.when(hot(0).isNotNull(), F.concat(F.lit("\n"), F.xxhash64("url", *own).cast("string"))).otherwise(F.col("suffix"))
            return df.withColumn("_key", apart).join(others, F.col("_key") == F.col("_suffix"), "left")

        base, known = with_rates(base, "page_id"), with_rates(known, *key)
    stat = lambda i, other: F.coalesce(hot(i), *([] if few else [F.col(("_rate", "_seen")[i])]), F.lit(other))
    all_features = {**features(F.col("url"), F.col("host"), F.col("path")), "suffix_rate": stat(0, overall), "suffix_seen": stat(1, 0.0)}
    columns = [c.cast("double").alias(name) for name, c in all_features.items()]
    # Rows with the least hashes. A limit on the hash leaves about twice as many as are wanted, so
    # that the tasks together, not each of them, send so many to the driver.
    rank, n = F.xxhash64("url", *key), known.count()
    if n > 2 * s.max_train:
        known = known.where(rank < int((2 * s.max_train / n - 0.5) * 2**64))
    some = known.orderBy(rank, "url", "y").limit(s.max_train).select("y", *columns).collect()
    rows = np.array([tuple(r) for r in some], float).reshape(len(some), len(columns) + 1)
    start, trees = fit(rows[:, 1:], rows[:, 0], s) if len(rows) else (-1.0, [])
    out = base.select("page_id", "host", "path", "rule", "says", *columns)
    odds = reduce(lambda a, t: a + t.column([F.col(n) for n in all_features]), trees, F.lit(start))
    out = out.withColumn("block_odds", odds)
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("block_odds") >= 0, "block").otherwise("allow")).alias("verdict"), "block_odds")
