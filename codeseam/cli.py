"""The commands: a scan of a folder or repository, an analysis, and a small report of it."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, report, shapes
from .functions.lines import lines_of
from .functions.paths import Exclusions
from .operators import dependencies, duplicates, history, metrics, score, smells
from .operators.files import ALL, file_measures, functions
from .shipping import ship
from .sources.findings import write_findings
from .sources.history import history_table, kept_hunks, repository
from .sources.tree import Scan, source_files
from .storage import stored

FORMATS = ("table", "json", "short", "terse", "github", "codeclimate", "gitlab", "markdown")
#: Commands whose findings have a place in a file.
WITH_FINDINGS = ("cycom", "cogcom", "smells")


@dataclass
class Context:
    """What the commands share: the options, the settings and the tables, each made when asked for."""

    spark: SparkSession
    options: argparse.Namespace
    #: Which of shapes.HEADLINES and shapes.FIELDS fit the result, if not those of the command.
    view: str | None = None

    @cached_property
    def repository(self) -> tuple[str, str]:
        return repository(self.options.path)

    @cached_property
    def project(self) -> dict:
        try:
            root = self.repository[0]
        except (ValueError, OSError):
            root = None
        return config.project_file(self.options.path, root)

    def setting(self, section: str, key: str):
        return config.setting(section, key, getattr(self.options, key, None), self.project)

    def scan(self, paths: tuple[str, ...] | None = None) -> Scan:
        o = self.options
        return Scan(o.path, o.include_tests, Exclusions(tuple(o.exclude_ext), tuple(o.include_ext), tuple(o.exclude_dir), tuple(o.exclude)), paths)

    @cached_property
    def files(self) -> DataFrame:
        return source_files(self.spark, self.scan())

    def files_at(self, ref: str) -> DataFrame:
        """The tree as it was, with the same exclusions; paths below the scanned folder."""
        x = Exclusions(self.scan().exclusions.extensions, self.scan().exclusions.only, self.scan().exclusions.folders, self.scan().exclusions.globs, tests=not self.options.include_tests)
        return self.below(history_table(self.spark, self.options.path, "files", ref)).where(x.keeps(F.col("path")))

    def below(self, table: DataFrame) -> DataFrame:
        """Rows of a repository's table that lie in the scanned folder, with paths relative to it."""
        prefix = self.repository[1]
        return table.where(F.col("path").startswith(prefix)).withColumn("path", F.substr("path", F.lit(len(prefix) + 1))) if prefix else table

    @cached_property
    def since(self):
        return F.timestamp_seconds(F.lit(config.since(self.options.since, int(time.time())))) if self.options.since else None

    @cached_property
    def languages(self) -> DataFrame:
        return self.files.select("path", "language")

    @cached_property
    def commits(self) -> DataFrame:
        found = history_table(self.spark, self.options.path, "commits")
        return found if self.since is None else found.where(F.col("ts") >= self.since)

    @cached_property
    def commit_files(self) -> DataFrame:
        found = self.below(history_table(self.spark, self.options.path, "commit_files"))
        return (found if self.since is None else found.where(F.col("committed") >= self.since)).drop("committed")

    @cached_property
    def frequencies(self) -> DataFrame:
        return history.file_frequencies(self.commit_files, self.commits, self.since)

    @cached_property
    def hunks(self) -> DataFrame:
        folder = getattr(self.options, "keep_ownership", None)
        found = kept_hunks(self.spark, self.options.path, folder) if folder else history_table(self.spark, self.options.path, "hunks")
        return self.below(found).join(self.languages.select("path"), "path", "left_semi")

    def measures(self, window: int = 6, files: DataFrame | None = None, parts: tuple[str, ...] = ALL) -> DataFrame:
        return stored(file_measures(self.files if files is None else files, window, strip_tests=not self.options.include_tests, parts=parts), "measures")

    def top(self, df: DataFrame, *order) -> DataFrame:
        return df.orderBy(*order).limit(self.options.top)


def loc(c: Context) -> DataFrame:
    if c.options.by_author:
        c.view = "loc_authors"
        c.json = lambda result: shapes.with_totals("authors", shapes.entries(c.view, result))
        return metrics.loc_by_author(lines_of(text_of(c.files)), c.hunks).orderBy(F.desc("code"), "email")
    counted = file_measures(duplicates.distinct_files(c.files), lenient=True, parts=())
    c.json = lambda result: shapes.with_totals("languages", shapes.entries("loc", result.where("language is not null")))
    c.before = lambda rows: text_files(c, rows) if c.options.verbose else ""
    return counted.where("error is null").rollup("language").agg(F.count("*").alias("files"), F.sum("blank").alias("blank"), F.sum("comment").alias("comment"), F.sum("code").alias("code")).orderBy(F.col("language").isNull(), F.desc("code"))


def text_files(c: Context, rows: list[dict]) -> str:
    """How many files were found, counted and left out, and how fast."""
    one = c.files.agg(F.count("*").alias("files"), F.count_distinct(F.sha2("content", 256)).alias("texts")).first()
    total = next((r for r in rows if r["language"] is None), dict.fromkeys(("files", "blank", "comment", "code"), 0))
    took = time.perf_counter() - c.started
    counts = [(one["files"], "text files"), (total["files"] or 0, "unique files"), (one["files"] - one["texts"], "files ignored (duplicates)"), (one["texts"] - (total["files"] or 0), "files ignored (binary)")]
    lines = sum(total[k] or 0 for k in ("blank", "comment", "code"))
    return "\n".join([*(f"{n:>8} {text}." for n, text in counts), f"T={took:.2f} s ({(total['files'] or 0) / took:.1f} files/s, {lines / took:.1f} lines/s)", ""])


def text_of(files: DataFrame) -> DataFrame:
    """Contents as text; bytes that are no UTF-8 become the replacement character."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.col("content"))


def found_duplicates(c: Context, files: DataFrame | None = None, parts: tuple[str, ...] = ("windows",)) -> tuple[DataFrame, DataFrame]:
    size = c.setting("dups", "min_lines")
    m = c.measures(size, files, parts)
    return duplicates.blocks(duplicates.window_groups(m), size), m


def dups(c: Context) -> DataFrame:
    blocks, m = found_duplicates(c)
    one = duplicates.summary(blocks, m)
    found = one.first()
    before = duplicates.summary(*found_duplicates(c, c.files_at(c.options.fail_on_increase))).first()["duplication_percentage"] if c.options.fail_on_increase else None
    c.gate = lambda: score.check_duplication(found["duplicate_groups"], found["duplication_percentage"], c.setting("dups", "max_duplicates"), c.setting("dups", "max_dup_ratio"), before)
    c.values = lambda result: found.asDict()
    groups = duplicates.located(blocks, m, lines_of(text_of(c.files))).orderBy("place").drop("place")
    groups = groups if c.options.show_all else groups.limit(20)
    place = "transform(locations, x -> struct(x.path as file_path, x.start_line as start_line, x.end_line as end_line)) as locations"
    c.json = lambda result: {"metrics": {k: found[k] for k in ("total_code_lines", "duplicated_lines", "duplication_percentage", "duplicate_groups", "files_with_duplicates", "largest_block", "assessment")}, "groups": report.rows_of(groups.selectExpr(place, "line_count", "sample", "initcap(severity) as severity"))}
    return groups if c.options.report else one


def complexity(measure: str) -> Callable[[Context], DataFrame]:
    def command(c: Context) -> DataFrame:
        m = c.measures(parts=("functions",))
        least = c.setting("cycom" if measure == "cyclomatic" else "cogcom", "min_complexity")
        c.findings = lambda: report.complexity_findings(functions(m), measure, least)
        if c.options.per_function:
            c.view = "functions" if c.options.format in ("table", "markdown") else None
        files = c.top(metrics.complexity(m, measure, least), F.desc(c.options.sort_by), "path")

        def as_json(result: DataFrame) -> list[dict]:
            own = {r["path"]: r.asDict(recursive=True)["functions"] for r in m.join(result.select("path"), "path").select("path", metrics.function_levels(measure).alias("functions")).collect()}
            return [r | {"functions": own[r["path"]]} for r in shapes.entries(c.options.command, result)]

        c.json = as_json
        if c.view:
            return c.top(functions(m).where(F.col(measure) >= least).select("path", "name", "start_line", measure), F.desc(measure), "path", "start_line")
        return files

    return command


def hal(c: Context) -> DataFrame:
    return c.top(metrics.halstead(c.measures(parts=("tokens",))), F.desc(c.options.sort_by), "path")


def index(verifysoft: bool) -> Callable[[Context], DataFrame]:
    own = ("mi_woc", "mi_cw", "miv_score", "miv_level", "comment") if verifysoft else ("mi_score", "mi_level")

    def command(c: Context) -> DataFrame:
        by = {"mi": F.asc(own[2] if verifysoft else own[0]), "volume": F.desc("volume"), "complexity": F.desc("total_complexity"), "loc": F.desc("code")}
        return c.top(metrics.maintainability(c.measures(parts=("tokens", "functions"))).select("path", "language", "volume", "total_complexity", "code", *own), by[c.options.sort_by], "path")

    return command


def indent(c: Context) -> DataFrame:
    return metrics.indent_metrics(c.measures(parts=("indent",))).orderBy(F.desc("indent_stddev"), "path")


def churn(c: Context) -> DataFrame:
    by = {"commits": F.desc("commits"), "rate": F.desc("rate_per_month"), "file": F.asc("path")}
    c.values = lambda result: shapes.values("churn", result) | {"top": first["path"] if (first := result.first()) else "-"}
    return c.top(history.churn(c.frequencies).join(c.languages, "path"), by[c.options.sort_by], "path")


def hotspots(c: Context) -> DataFrame:
    kind = c.options.complexity
    m = c.measures(parts=("indent",) if kind == "indent" else ("functions",))
    totals = m.where("code > 0").select("path", F.col("total_indent").alias("complexity")) if kind == "indent" else metrics.complexity(m, {"cycom": "cyclomatic", "cogcom": "cognitive"}[kind]).select("path", F.col("total").alias("complexity"))
    c.values = lambda result: first.asDict() if (first := result.first()) else {"path": "-", "score": 0, "commits": 0, "complexity": 0}
    found = history.hotspots(totals, c.frequencies).join(c.languages, "path").withColumn("complexity_metric", F.lit(kind))
    return c.top(found, F.desc(c.options.sort_by), "path")


def knowledge(c: Context) -> DataFrame:
    recent = history.recent_authors(c.commits, c.since) if c.since is not None else None
    blame = history.blame_summary(c.hunks)
    if c.options.bus_factor:
        c.view = "bus_factor"
        c.json = lambda result: shapes.of_authors(shapes.entries("bus_factor", result))
        return history.bus_factor(blame).orderBy(F.desc("lines"), "author")
    owned = history.knowledge(blame, recent, c.options.author, c.options.risk_only)
    if c.options.summary:
        c.view = "knowledge_summary"
        return history.ownership_by_author(owned, c.languages).orderBy(F.desc("files_owned"), "author")
    return history.ordered_knowledge(owned.join(c.languages, "path"), c.options.sort_by, c.options.top)


def tc(c: Context) -> DataFrame:
    pairs = history.temporal_coupling(c.commit_files, c.frequencies, c.setting("tc", "min_degree"), c.setting("tc", "min_strength"), keep_tests=c.options.include_tests)
    if c.options.exclude_ext or c.options.exclude_dir or c.options.exclude or c.options.include_ext:
        print("warning: exclusions have no effect on tc, which reads the history, not the tree", file=sys.stderr)

    def values(result: DataFrame) -> dict:
        found = pairs.count()
        c.view = "tc" if found else "tc_none"
        return shapes.values("tc", result) | {"pairs": found}

    c.values = values
    return c.top(pairs, F.desc({"strength": "strength", "shared": "shared_commits"}[c.options.sort_by]), "file_a", "file_b")


def age(c: Context) -> DataFrame:
    aged = history.age(c.frequencies, F.current_timestamp(), c.setting("age", "active_days"), c.setting("age", "frozen_days")).join(c.languages, "path")
    aged = aged.where(F.col("status") == c.options.status.upper()) if c.options.status else aged
    return aged.orderBy({"date": F.asc("last_ts"), "status": F.desc("status"), "file": F.asc("path")}[c.options.sort_by], "path")


def authors(c: Context) -> DataFrame:
    return history.authors(history.blame_summary(c.hunks), c.languages, c.since).orderBy(F.desc("lines"), "email")


def deps(c: Context) -> DataFrame:
    module = None
    mod = os.path.join(c.options.path, "go.mod")
    if os.path.exists(mod):
        with open(mod, encoding="utf-8") as f:
            module = next((line.split()[1] for line in f if line.startswith("module ")), None)
    edges = dependencies.import_edges(c.files, module)
    fan = history.dependency_fan(edges).withColumnRenamed("file", "path").join(c.languages, "path")
    cycle = history.cycles(edges).withColumnRenamed("file", "path")
    out = fan.join(cycle, "path", "inner" if c.options.cycles_only else "left")
    return c.top(out, F.desc({"fan-out": "fan_out", "fan-in": "fan_in"}[c.options.sort_by]), "path")


def smelled(c: Context) -> DataFrame:
    paths = tuple(c.options.files) if c.options.files else None
    if c.options.since_ref:
        hashed = lambda df: df.select("path", F.sha2("content", 256).alias("content_hash"))
        changed = history.files_changed_since(hashed(c.files_at(c.options.since_ref)), hashed(c.files_at("HEAD")))
        files = c.files.join(changed, "path", "left_semi")
    else:
        files = source_files(c.spark, c.scan(paths)) if paths else c.files
    m = c.measures(files=files, parts=("functions",))
    lines, found = lines_of(text_of(files)), functions(m)
    each = smells.smells(lines, found, c.setting("smells", "max_lines"), c.setting("smells", "max_params"))
    counts = c.top(smells.smell_counts(each), F.desc("total"), "path")
    title = F.element_at(F.create_map(*(F.lit(x) for k, (_, name) in smells.TITLES.items() for x in (k, name))), F.col("smell"))
    placed = each.join(counts.select("path", "total"), "path").orderBy(F.desc("total"), "path", "line_no")
    c.findings = lambda: placed.select("path", F.col("line_no").alias("line"), title.alias("title"), F.col("detail").alias("message"), F.lit("minor").alias("severity"))
    c.json = lambda result: shapes.entries("smells", smells.listed(each, result).join(files.select("path", "language"), "path").orderBy(F.desc("total"), "path"))
    return counts


def project_score(c: Context) -> DataFrame:
    model, size = c.setting("score", "model"), c.setting("score", "min_lines")

    def of(files: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        m = c.measures(size, files)
        scores = score.file_scores(m, model)
        blocks = duplicates.blocks(duplicates.window_groups(m), size)
        return score.dimensions(scores, duplicates.summary(blocks, m), model), scores

    dims, scores = of(None)
    if c.options.trend:
        old_dims, old_scores = of(c.files_at(c.options.trend))
        diff = score.difference(old_dims, dims)
        whole = diff.where("name = 'overall'").first()
        c.view = "score_diff"
        c.values = lambda result: {"ref": c.options.trend, "before": whole["before_score"], "after": whole["after_score"], "delta": whole["delta"], "grade": whole["after_grade"]}

        def as_json(result: DataFrame) -> dict:
            def side(name: str, scored: DataFrame) -> dict:
                sizes = scored.agg(F.count("*").alias("files"), F.coalesce(F.sum("code"), F.lit(0)).alias("loc")).first()
                return {"score": whole[f"{name}_score"], "grade": whole[f"{name}_grade"]} | sizes.asDict()

            rows = [r | {"name": score.NAMES[r["name"]]} for r in shapes.entries("score_diff", result.where("name <> 'overall'"))]
            return {"git_ref": c.options.trend, "before": side("before", old_scores), "after": side("after", scores), "delta": whole["delta"], "dimensions": rows}

        c.json = as_json
        c.gate = lambda: score.check_score(whole["before_score"], whole["after_score"], whole["after_grade"], c.setting("score", "fail_if_worse"), c.setting("score", "fail_below"))
        return diff.orderBy("position")
    whole, worst = score.project(dims, scores), score.worst_files(scores, c.setting("score", "bottom"), model)
    named = lambda result: [r | {"name": score.NAMES[r["name"]]} for r in shapes.entries("score", result)]
    c.values = lambda result: whole.first().asDict() | {"parts": " ".join(f"{r['name'].split()[0].lower()}:{r['score']:.1f}" for r in named(result))}
    c.json = lambda result: {"target": c.options.path} | whole.select("score", "grade", "files_analyzed", "total_loc").first().asDict() | {"dimensions": named(result), "needs_attention": shapes.entries("score_file", worst)}
    c.extra = lambda: [("Score", whole), ("Needs attention", worst)]
    return dims.orderBy("position")


def whole_report(c: Context) -> DataFrame:
    """Every analysis of one reading, a section each: name, rows in all, the first ones as JSON."""
    top = 1_000_000 if c.options.full else c.options.top
    files = duplicates.distinct_files(c.files)
    m = stored(file_measures(files, c.setting("dups", "min_lines")), "measures")
    blocks = duplicates.blocks(duplicates.window_groups(m), c.setting("dups", "min_lines"))
    index_ = metrics.maintainability(m)
    parts = [
        ("loc", "Lines by language", m.groupBy("language").agg(F.count("*").alias("files"), F.sum("blank").alias("blank"), F.sum("comment").alias("comment"), F.sum("code").alias("code")).orderBy(F.desc("code"), "language"), top),
        ("duplication", "Duplicated blocks", duplicates.located(blocks, m).orderBy("place").drop("place"), top),
        ("indent", "Depth of indentation", metrics.indent_metrics(m).orderBy(F.desc("indent_stddev"), "path"), top),
        ("halstead", "Token metrics", metrics.halstead(m).orderBy(F.desc("effort"), "path"), top),
        ("cyclomatic", "Paths through the code", metrics.complexity(m).orderBy(F.desc("total"), "path"), top),
        ("mi_visual_studio", "Maintainability, 0 to 100", index_.select("path", "language", "volume", "total_complexity", "code", "mi_score", "mi_level").orderBy("mi_score", "path"), top),
        ("mi_verifysoft", "Maintainability with comments", index_.select("path", "language", "volume", "total_complexity", "code", "comment", "mi_woc", "mi_cw", "miv_score", "miv_level").orderBy("miv_score", "path"), top),
    ]
    c.sections = lambda: report.sections(c.options.path, parts)
    c.values = lambda result: m.agg(F.count("*").alias("files"), F.count_distinct("language").alias("langs"), F.coalesce(F.sum("code"), F.lit(0)).alias("code")).first().asDict() | duplicates.summary(blocks, m).first().asDict()
    return parts[0][2]


def init(c: Context) -> DataFrame:
    """Suggested settings from what the project is like: limits a little above the means."""
    blocks, m = found_duplicates(c, parts=ALL)
    found = functions(m).where("name <> '<file>'").agg(F.coalesce(F.avg("n_lines"), F.lit(0.0)).alias("length"), F.coalesce(F.avg("n_params"), F.lit(0.0)).alias("params")).first()
    share = duplicates.summary(blocks, m).first()["duplication_percentage"]
    scores = score.file_scores(m)
    grade = score.project(score.dimensions(scores, duplicates.summary(blocks, m)), scores).first()["grade"]
    order = [g for _, g in score.GRADES] + [score.LAST_GRADE]
    length = 50 if found["length"] < 1 else max(20, (int(found["length"]) // 5 + 1) * 5 + 5)
    params = max(3, -int(-found["params"] // 1))
    ratio = max(2.0, -(-share * 2 // 1) / 2)
    text = f"[smells]\nmax_lines = {length}\nmax_params = {params}\n\n[dups]\nmax_dup_ratio = {ratio}\n\n[score]\nfail_below = \"{order[min(order.index(grade) + 1, len(order) - 1)]}\"\n"
    path = os.path.join(c.options.path, "codeseam.toml")
    if not c.options.yes and os.path.exists(path):
        raise ValueError(f"{path} is there already; -y writes over it")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return c.spark.createDataFrame([(path, length, params, ratio, grade)], "path string, max_lines int, max_params int, max_dup_ratio double, grade string")


#: command -> (what it does, its function)
COMMANDS: dict[str, tuple[str, Callable[[Context], DataFrame]]] = {
    "loc": ("lines by language, or by author", loc), "dups": ("duplicate blocks", dups), "indent": ("depth of indentation", indent), "hal": ("token metrics", hal),
    "cycom": ("cyclomatic complexity", complexity("cyclomatic")), "cogcom": ("cognitive complexity", complexity("cognitive")), "mi": ("maintainability index", index(False)), "miv": ("maintainability index with comments", index(True)),
    "report": ("all of these", whole_report), "churn": ("how often files change", churn), "hotspots": ("complex files that change often", hotspots), "knowledge": ("who owns files", knowledge), "tc": ("files that change together", tc),
    "smells": ("code smells", smelled), "score": ("health score", project_score), "age": ("when files changed last", age), "deps": ("imports and their cycles", deps), "authors": ("authors and what they own", authors), "init": ("suggest settings", init),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeseam", description="Analytics of source code and its history.")
    sub = out.add_subparsers(dest="command", required=True)
    for name, (text, _) in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--format", choices=FORMATS, default="table")
        p.add_argument("--include-tests", action="store_true")
        ext = p.add_mutually_exclusive_group()
        ext.add_argument("--include-ext", action="append", default=[])
        ext.add_argument("--exclude-ext", action="append", default=[])
        p.add_argument("--exclude-dir", action="append", default=[])
        p.add_argument("-E", "--exclude", action="append", default=[])
        p.add_argument("--list-excluded", action="store_true")
        p.add_argument("--top", type=int, default=20)
        p.add_argument("--since")
        orders = {"hal": ("effort", "volume", "bugs"), "cycom": ("total", "max", "avg"), "cogcom": ("total", "max", "avg"), "mi": ("mi", "volume", "complexity", "loc"), "miv": ("mi", "volume", "complexity", "loc"), "churn": ("commits", "rate", "file"), "hotspots": ("score", "commits", "complexity"), "knowledge": ("concentration", "diffusion", "risk"), "tc": ("strength", "shared"), "age": ("date", "status", "file"), "deps": ("fan-out", "fan-in")}
        if name in orders:
            p.add_argument("--sort-by", choices=orders[name], default=orders[name][0])
        more = {
            "loc": [("--by-author", bool), ("--verbose", bool), ("--keep-ownership", str)], "authors": [("--keep-ownership", str)], "dups": [("--report", bool), ("--show-all", bool), ("--min-lines", int), ("--max-duplicates", int), ("--max-dup-ratio", float), ("--fail-on-increase", str)],
            "cycom": [("--min-complexity", int), ("--per-function", bool)], "cogcom": [("--min-complexity", int), ("--per-function", bool)], "report": [("--min-lines", int), ("--full", bool)],
            "knowledge": [("--risk-only", bool), ("--summary", bool), ("--bus-factor", bool), ("--author", str), ("--keep-ownership", str)], "tc": [("--min-degree", int), ("--min-strength", float)],
            "smells": [("--max-lines", int), ("--max-params", int), ("--since-ref", str)], "score": [("--bottom", int), ("--min-lines", int), ("--fail-below", str)],
            "age": [("--active-days", int), ("--frozen-days", int), ("--status", str)], "deps": [("--cycles-only", bool)], "init": [("--yes", bool)],
        }
        for flag, kind in more.get(name, []):
            p.add_argument(flag, **({"action": "store_true"} if kind is bool else {"type": kind}))
        if name in WITH_FINDINGS:
            p.add_argument("--into", metavar="FOLDER", help="write annotations or code-quality entries to files of a shared folder, by tasks")
        if name == "hotspots":
            p.add_argument("--complexity", choices=("indent", "cycom", "cogcom"), default="indent")
        if name == "smells":
            p.add_argument("--files", nargs="*")
        if name == "score":
            p.add_argument("--model", choices=tuple(score.MODELS))
            p.add_argument("--trend", "--git-ref", nargs="?", const="HEAD")
            p.add_argument("--fail-if-worse", action="store_const", const=True)
    return out


def rendered(c: Context, result: DataFrame) -> str:
    o = c.options
    title = COMMANDS[o.command][0].capitalize()
    if o.format in ("github", "codeclimate", "gitlab"):
        if o.command not in WITH_FINDINGS:
            raise ValueError(f"the format {o.format} is for {', '.join(WITH_FINDINGS)} only")
        if o.into:
            return f"{write_findings(c.findings(), o.into, 'annotations' if o.format == 'github' else 'quality')} finding(s) in {o.into}"
        found = report.rows_of(c.findings())
        return report.annotations(found) if o.format == "github" else report.quality_entries(found)
    if o.format in ("short", "terse"):
        of = c.values(result) if hasattr(c, "values") else shapes.values(c.view or o.command, result)
        return shapes.headline(c.view or o.command, of, o.format == "terse")
    if sections := getattr(c, "sections", None):
        found = sections()
        if o.format == "json":
            return report.as_json(found)
        as_text = report.markdown if o.format == "markdown" else report.table
        return "\n".join(as_text(f"{s['section']}: {s['description']} ({s['total_count']} in all)", s["entries"]) for s in found)
    if o.format == "json":
        return report.as_json(c.json(result) if hasattr(c, "json") else shapes.entries(c.view or o.command, result))
    parts = [(title, result), *(c.extra() if hasattr(c, "extra") else [])]
    rows = [(name, report.rows_of(df)) for name, df in parts]
    before = c.before(rows[0][1]) if hasattr(c, "before") and o.format == "table" else ""
    return before + "\n".join((report.markdown if o.format == "markdown" else report.table)(name, found) for name, found in rows)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the report of a command; 1 with `error: ...` if it fails or a gate does not hold."""
    args = list(sys.argv[1:] if args is None else args)
    if args[:2] == ["score", "diff"]:  # the score against that of a ref, HEAD unless --git-ref names one
        args = ["score", *args[2:], *([] if any(a.split("=")[0] == "--git-ref" for a in args) else ["--git-ref", "HEAD"])]
    options = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("codeseam").getOrCreate()
    ship(spark)
    c = Context(spark, options)
    c.started = time.perf_counter()
    try:
        if options.list_excluded:
            x = Exclusions(tuple(options.exclude_ext), tuple(options.include_ext), tuple(options.exclude_dir), tuple(options.exclude), tests=not options.include_tests)
            left_out = source_files(spark, Scan(options.path, include_tests=True)).select("path", x.reasons(F.col("path")).alias("reasons")).where("reasons <> ''").orderBy("path")
            rows = report.rows_of(left_out)
            print(report.table("Excluded files", rows) + f"\n\n{len(rows)} file(s) excluded")
            return 0
        print(rendered(c, COMMANDS[options.command][1](c)))
        if gate := getattr(c, "gate", None):
            gate()
    except (ValueError, OSError, score.GateError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
