"""A folder of source files as a table, read by a Python data source."""

from __future__ import annotations

import json
import os
import re
import subprocess
import warnings
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.languages import BY_EXTENSION, BY_FILE, by_shebang
from ..functions.paths import TEST_DIRS, Exclusions, test_name_pattern, valid_globs
from ..storage import stored

SCHEMA = "path string, language string, content binary"
ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("content", pa.binary())])
#: Folders that a task opens, files that a task reads.
FOLDERS, FILES = 64, 1024
#: Files and folders that the driver lists by itself.
LISTED = 20_000


def language_of(name: str, first: bytes = b"") -> str | None:
    """By file name, by extension, else by the first line of a script."""
    ext = name.rpartition(".")[2] if "." in name[1:] else None
    return BY_FILE.get(name) or BY_EXTENSION.get(ext) or by_shebang(first.decode("utf-8", "replace"))


@dataclass(frozen=True)
class Ignore:
    """One line of an ignore file, as an expression over paths below its folder."""

    base: str
    pattern: str
    negated: bool
    folders_only: bool

    @staticmethod
    def parse(base: str, line: str) -> Ignore | None:
        line = line.rstrip("\n")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            return None
        negated, line = line.startswith("!"), line.removeprefix("!")
        folders_only, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        out = "" if anchored else "(?:.*/)?"
        i = 0
        while i < len(line):
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                out, i = out + "/.*", i + 3
            elif line[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif line[i] == "?":
                out, i = out + "[^/]", i + 1
            elif line[i] == "[" and (close := line.find("]", i + 2)) > 0:
                inside = line[i + 1 : close]
                out, i = out + f"[{'^' + inside[1:] if inside[0] in '!^' else inside}]", close + 1
            else:
                i += line[i] == "\\"
                out, i = out + re.escape(line[i : i + 1]), i + 1
        return Ignore(base, out, negated, folders_only)

    def fits(self, path: str, folder: bool) -> bool:
        if self.folders_only and not folder:
            return False
        return re.fullmatch(self.pattern, path[len(self.base) :]) is not None


def lines_in(path: str) -> tuple[str, ...]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return tuple(f)
    except OSError:
        return ()


def parsed(base: str, lines: tuple[str, ...]) -> tuple[Ignore, ...]:
    return tuple(x for line in lines if (x := Ignore.parse(base, line)))


def user_lines() -> tuple[str, ...]:
    """The ignore lines of the user for all repositories."""
    try:
        named = subprocess.run(["git", "config", "--global", "--path", "core.excludesFile"], capture_output=True, text=True).stdout.rstrip("\n")
    except OSError:
        named = ""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return lines_in(named or os.path.join(home, "git", "ignore"))


@dataclass(frozen=True)
class Rules:
    """The ignore lines that hold in a folder, the nearest file first in each kind: .ignore files
    at and above it; in a repository also .gitignore files up to its root, the root's
    .git/info/exclude, and the user's. The first kind and file with a line that fits decides, by
    its last such line. Without a repository around a folder only .ignore files hold."""

    user: tuple[str, ...] = ()
    own: tuple[tuple[Ignore, ...], ...] = ()
    of_git: tuple[tuple[Ignore, ...], ...] = ()
    of_repository: tuple[tuple[Ignore, ...], ...] = ()

    def inside(self, folder: str) -> Rules:
        """The rules in a folder (absolute, with a slash at its end) right below this one."""
        root = os.path.exists(folder + ".git")
        own = (parsed(folder, lines_in(folder + ".ignore")), *self.own)
        of_git = (parsed(folder, lines_in(folder + ".gitignore")), *(() if root else self.of_git))
        whole = (parsed(folder, lines_in(folder + ".git/info/exclude")), parsed(folder, self.user)) if root else self.of_repository
        return Rules(self.user, own, of_git, whole)

    def ignores(self, path: str, folder: bool) -> bool:
        for lines in (*self.own, *((*self.of_git, *self.of_repository) if self.of_repository else ())):
            if last := next((r for r in reversed(lines) if r.fits(path, folder)), None):
                return not last.negated
        return False

    @staticmethod
    def at(folder: str) -> Rules:
        """The rules in a folder, with those of all folders above it."""
        out, above = Rules(user_lines()), ""
        for part in folder.rstrip("/").split("/"):
            above += part + "/"
            out = out.inside(above)
        return out


@dataclass(frozen=True)
class Scan:
    """What a scan of a folder reads: `exclusions` leave files out (their tests too, unless
    include_tests); with `only_paths`, only these files, told by their names alone."""

    root: str
    include_tests: bool = False
    exclusions: Exclusions = Exclusions()
    only_paths: tuple[str, ...] | None = None

    def skips_folder(self, name: str) -> bool:
        return name == ".git" or name in self.exclusions.folders or (not self.include_tests and name in TEST_DIRS)

    def skips_file(self, path: str) -> bool:
        name = path.rpartition("/")[2]
        x = self.exclusions
        if not self.include_tests and re.match(test_name_pattern(), name):
            return True
        ext = name.rpartition(".")[2].lower() if "." in name[1:] else None
        if x.only:
            if ext not in x.plain(x.only):
                return True
        elif ext in x.plain(x.extensions):
            return True
        return any(re.match(p, path) for p in valid_globs(x.globs))

    def entries(self, base: str, rules: Rules) -> Iterator[tuple[str, str, str | None]]:
        """(path, kind, error) of what a folder holds and the scan keeps: kind "file" or "folder"
        (paths of folders end with a slash), or one row "error" for a folder that cannot be read.
        Symbolic links are not followed."""
        try:
            found = sorted(os.scandir(os.path.join(self.root, base)), key=lambda e: e.name)
        except OSError as e:
            yield base, "error", e.strerror or str(e)
            return
        for e in found:
            path, whole = f"{base}{e.name}", os.path.join(self.root, base, e.name)
            if e.is_dir(follow_symlinks=False):
                if not self.skips_folder(e.name) and not rules.ignores(whole, True):
                    yield path + "/", "folder", None
            elif e.is_file(follow_symlinks=False) and not self.skips_file(path) and not rules.ignores(whole, False):
                yield path, "file", None

    def listed(self, top: Rules, most: int | None = None) -> tuple[list[str], list[str]]:
        """(files, folders not opened yet) after listing folders, level by level, until over `most`
        files and folders are known or none is left to open."""
        files, waiting, known = [], deque([""]), Known(self.root, top)
        while waiting and (most is None or len(files) + len(waiting) <= most):
            base = waiting.popleft()
            for path, kind, error in self.entries(base, known.of(base)):
                if kind == "error":
                    warnings.warn(f"{path or self.root}: {error}", stacklevel=2)
                else:
                    (files if kind == "file" else waiting).append(path)
        return files, list(waiting)


class Known:
    """Rules of folders below a root, each read once: for one task or one listing."""

    def __init__(self, root: str, top: Rules):
        self.root, self.rules = root, {"": top}

    def of(self, base: str) -> Rules:
        if base not in self.rules:
            above = base[:-1].rpartition("/")
            self.rules[base] = self.of(above[0] + above[1]).inside(os.path.join(self.root, base))
        return self.rules[base]


def as_json(scan: Scan, found: list[str] | None = None) -> str:
    x = scan.exclusions
    return json.dumps({"include_tests": scan.include_tests, "extensions": x.extensions, "only": x.only, "folders": x.folders, "globs": x.globs, "only_paths": scan.only_paths, "found": found})


def from_json(root: str, text: str) -> tuple[Scan, list[str] | None]:
    d = json.loads(text)
    paths = None if d["only_paths"] is None else tuple(d["only_paths"])
    return Scan(root, d["include_tests"], Exclusions(tuple(d["extensions"]), tuple(d["only"]), tuple(d["folders"]), tuple(d["globs"])), paths), d["found"]


def contents(root: str, paths: Iterable[str], by_name: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of the files of a known language; by_name: told by their names alone."""
    rows, size = [], 0
    for path in paths:
        try:
            with open(os.path.join(root, path), "rb") as f:
                content = f.read()
        except OSError:
            continue  # as a file that has gone since it was listed
        if language := language_of(path.rpartition("/")[2], b"" if by_name else content[:200].split(b"\n")[0]):
            rows.append({"path": path, "language": language, "content": content})
            size += len(content)
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Files(InputPartition):
    paths: list


class TreeReader(DataSourceReader):
    def __init__(self, scan: Scan, found: list[str] | None):
        self.scan, self.found = scan, found

    def partitions(self) -> list[InputPartition]:
        names = self.found if self.scan.only_paths is None else list(self.scan.only_paths)
        if names is None:
            names = self.scan.listed(Rules.at(self.scan.root))[0]
        return [Files(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return contents(self.scan.root, partition.paths, by_name=self.scan.only_paths is not None)


class TreeSource(DataSource):
    """format("source_tree"), options path and scan. The driver lists the tree unless the scan
    names its files; tasks read the files, so all machines must see the path."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(*from_json(self.options["path"], self.options["scan"]))


def listed_by_tasks(spark: SparkSession, scan: Scan, top: Rules, files: list[str], folders: list[str]) -> DataFrame:
    """The paths of a large tree: a job opens all folders of a level, and the level it finds is a
    table in the shared folder, so the driver holds no level but the first."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(scan.root, top)
        for batch in batches:
            for base in batch.column("path").to_pylist():
                rows = scan.entries(base, known.of(base))
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "kind", "error"), x, strict=True)) for x in part], schema=pa.schema([(n, pa.string()) for n in ("path", "kind", "error")]))

    out = spark.createDataFrame([(p,) for p in files], "path string")
    level, n = spark.createDataFrame([(p,) for p in folders], "path string"), len(folders)
    while n:
        found = stored(level.repartition(-(-n // FOLDERS)).mapInArrow(opened, "path string, kind string, error string"), "tree")
        out = out.unionByName(found.where("kind = 'file'").select("path"))
        level = found.where("kind = 'folder'").select("path")
        n = level.count()
        failed = found.where("kind = 'error'")
        for r in failed.limit(20).collect():
            warnings.warn(f"{r['path']}: {r['error']}", stacklevel=2)
    return out


def source_files(spark: SparkSession, scan: Scan, most: int = LISTED) -> DataFrame:
    """(path, language, content) of the source files of a folder, paths relative to it: files of a
    known language that neither ignore files (`Rules`) nor the scan leave out. Hidden files count.
    A folder that cannot be read is left out with a warning (of a large tree, for the first 20 of a
    level). An empty folder gives no rows. The tree is listed when this is called: by the driver
    up to `most` files and folders, level by level by tasks beyond."""
    scan = replace(scan, root=os.path.abspath(scan.root))
    files = None
    if scan.only_paths is None:
        top = Rules.at(scan.root)
        files, folders = scan.listed(top, most)
        if folders:
            paths = listed_by_tasks(spark, scan, top, files, folders)
            read = lambda batches: (b for batch in batches for b in contents(scan.root, batch.column("path").to_pylist()))
            return paths.repartition(-(-paths.count() // FILES) or 1).mapInArrow(read, SCHEMA)
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("path", scan.root).option("scan", as_json(scan, files)).load()
