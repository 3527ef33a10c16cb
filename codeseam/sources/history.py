"""A version-control repository as tables, read by a Python data source that asks `git`."""

from __future__ import annotations

import hashlib
import operator
import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .tree import language_of

TIME = pa.timestamp("us", tz="UTC")
TABLES = {
    "commits": pa.schema([("commit_id", pa.string()), ("author", pa.string()), ("email", pa.string()), ("ts", TIME), ("n_parents", pa.int32())]),
    "commit_files": pa.schema([("commit_id", pa.string()), ("path", pa.string()), ("committed", TIME)]),
    "hunks": pa.schema([("path", pa.string()), ("start_line", pa.int64()), ("n_lines", pa.int64()), ("author", pa.string()), ("email", pa.string()), ("ts", TIME)]),
    "files": pa.schema([("path", pa.string()), ("language", pa.string()), ("content", pa.binary())]),
    "touched": pa.schema([("path", pa.string())]),
}
SPARK_TYPES = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", TIME: "timestamp"}
#: Commits, or files, of a task.
COMMITS, FILES = 2_000, 200


def run(root: str, *args: str, given: bytes = b"") -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", root, *args], input=given, capture_output=True)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


def repository(path: str) -> tuple[str, str]:
    """(root, prefix): the working tree that holds a path, and where the path is in it. A bare
    repository, or none, is an error."""
    if run(path, "rev-parse", "--is-bare-repository").strip() == b"true":
        raise ValueError("bare repositories are not supported")
    return run(path, "rev-parse", "--show-toplevel").decode().strip(), run(path, "rev-parse", "--show-prefix").decode().strip()


def micros(seconds: str) -> int:
    return int(seconds) * 1_000_000


def unquoted(path: str) -> str:
    """A path as listed; one with special characters is in quotes, with escapes."""
    if not path.startswith('"'):
        return path
    raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(m[1], m[1]), path[1:-1].encode())
    return raw.decode("utf-8", "replace")


def commits_of(root: str, ids: list[str]) -> Iterator[dict]:
    raw = run(root, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x1f%an%x1f%ae%x1f%ct%x1f%P", given="\n".join(ids).encode())
    for line in raw.decode("utf-8", "replace").split("\n"):
        if line:
            commit, author, email, ts, parents = line.split("\x1f")
            yield {"commit_id": commit, "author": author, "email": email, "ts": micros(ts), "n_parents": len(parents.split())}


def changes_of(root: str, ids: list[str], folder: str = "") -> Iterator[dict]:
    """Paths, those below a folder, that differ from the first parent; deleted ones too, renamed
    ones under both names. Merges show none."""
    below = ["--", f":(top,literal){folder}"] if folder else []
    raw = run(root, "diff-tree", "--stdin", "-r", "--root", "--no-renames", "--name-only", "--format=%x1f%H %ct", *below, given="\n".join(ids).encode() + b"\n")
    commit = committed = ""
    for line in raw.decode("utf-8", "replace").split("\n"):
        if line.startswith("\x1f"):
            commit, committed = line[1:].split(" ")
        elif line:
            yield {"commit_id": commit, "path": unquoted(line), "committed": micros(committed)}


def hunks_of(root: str, path: str, ref: str) -> Iterator[dict]:
    """Runs of lines that one commit changed last."""
    known: dict[str, dict] = {}
    commit = ""
    found = []
    for line in run(root, "blame", "--porcelain", ref, "--", path).decode("utf-8", "replace").split("\n"):
        if line.startswith("\t"):
            continue
        head = line.split(" ")
        if re.fullmatch(r"[0-9a-f]{40,64}", head[0]) and len(head) in (3, 4):
            commit = head[0]
            known.setdefault(commit, {})
            if len(head) == 4:
                found.append((commit, int(head[2]), int(head[3])))
        elif head[0] in ("author", "author-mail", "author-time"):
            known[commit][head[0]] = line[len(head[0]) + 1 :]
    for commit, start, n in found:
        who = known[commit]
        yield {"path": path, "start_line": start, "n_lines": n, "author": who.get("author", "unknown"), "email": who.get("author-mail", "<unknown>").strip("<>"), "ts": micros(who.get("author-time", "0"))}


def blobs_of(root: str, entries: list[tuple[str, str]]) -> Iterator[dict]:
    raw = run(root, "cat-file", "--batch", given="".join(f"{blob}\n" for blob, _ in entries).encode())
    at = 0
    for _, path in entries:
        end = raw.index(b"\n", at)
        size = int(raw[at:end].split()[-1])
        content, at = raw[end + 1 : end + 1 + size], end + size + 2
        if language := language_of(path.rpartition("/")[2], content[:200].split(b"\n")[0]):
            yield {"path": path, "language": language, "content": content}


def commit_of(root: str, ref: str) -> str:
    return run(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()


def touched(root: str, old: str, new: str) -> set[str] | None:
    """The paths whose lines may have other owners at `new` than at `old`; None: any may.

    All ways back from both must lead through one commit, from which on a path in no change, that of
    a merge against any of its parents included, kept its text and so the owners of its lines. The
    base moves back until that holds, so a branch that began before `old` is part of the range. What
    maps names to other names changes all owners.
    """
    if old == new:
        return set()
    try:
        base = run(root, "merge-base", old, new).decode().strip()
        while True:
            ends = {line[1:] for line in run(root, "rev-list", "--boundary", old, new, f"^{base}").decode().split() if line.startswith("-")}
            if ends <= {base}:
                break
            further = run(root, "merge-base", "--octopus", base, *sorted(ends)).decode().strip()
            if further == base:
                return None
            base = further
    except ValueError:  # no common commit, or `old` is gone
        return None
    raw = run(root, "log", "-m", "--no-renames", "--name-only", "--format=", "-z", old, new, f"^{base}")
    found = {path.lstrip("\n") for path in raw.decode("utf-8", "replace").split("\0")} - {""}
    return None if ".mailmap" in found else found


#: Comparisons that a listing, or a task before it makes rows, can decide by itself.
TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values, StringStartsWith: str.startswith}
#: The columns that they may name: the time of a commit, and paths.
TIMES, PATHS = {"commits": "ts", "commit_files": "committed"}, ("commit_files", "hunks", "files", "touched")


def holds(tests: list[tuple[type, object]], value) -> bool:
    return all(TESTS[kind](value, wanted) for kind, wanted in tests)


@dataclass
class Part(InputPartition):
    items: list


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.ref, path = options["table"], options.get("ref", "HEAD"), options["path"]
        self.root, self.prefix = repository(path)
        self.since_ref = options.get("since_ref")
        self.times: list[tuple[type, object]] = []
        self.paths: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what limits the time of commits and the paths; Spark does the others."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (*TESTS, IsNotNull)) and len(f.attribute) == 1 else None
            if column is not None and column == TIMES.get(self.table) and not isinstance(f, StringStartsWith):
                tests = self.times
            elif column == "path" and self.table in PATHS:
                tests = self.paths
            else:
                yield f
                continue
            if not isinstance(f, IsNotNull):  # no time and no path is null
                tests.append((type(f), f.value))

    def listed(self) -> list:
        """What the tasks share: commit ids, or files of the tree; never their contents. Only those
        that the filters keep."""
        if self.table in TIMES:
            if not self.times:
                return run(self.root, "rev-list", self.ref).decode().split()
            found = (line.split() for line in run(self.root, "log", "--format=%H %ct", self.ref).decode().splitlines())
            return [commit for commit, ts in found if holds(self.times, datetime.fromtimestamp(int(ts), timezone.utc))]
        changed = touched(self.root, commit_of(self.root, self.since_ref), commit_of(self.root, self.ref)) if self.since_ref else None
        if self.table == "touched":
            return sorted(path for path in changed or () if path.startswith(self.prefix) and holds(self.paths, path))
        out = []
        for entry in run(self.root, "ls-tree", "-r", "-z", self.ref, "--", self.prefix or ".").decode("utf-8", "replace").split("\0"):
            if entry:
                head, path = entry.split("\t", 1)
                mode, kind, blob = head.split()
                if kind == "blob" and mode != "120000" and (changed is None or path in changed) and holds(self.paths, path):  # neither links nor submodules
                    out.append((blob, path))
        return out

    def partitions(self) -> list[InputPartition]:
        items, size = self.listed(), COMMITS if self.table in TIMES else FILES
        return [Part(items[i : i + size]) for i in range(0, len(items), size)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = TABLES[self.table]
        if not partition.items:
            return
        if self.table == "commits":
            rows = commits_of(self.root, partition.items)
        elif self.table == "commit_files":
            folder = next((prefix.rpartition("/")[0] for kind, prefix in self.paths if kind is StringStartsWith), "")
            rows = (row for row in changes_of(self.root, partition.items, folder) if holds(self.paths, row["path"]))
        elif self.table == "hunks":
            rows = (h for _, path in partition.items if language_of(path.rpartition("/")[2]) for h in hunks_of(self.root, path, self.ref))
        elif self.table == "touched":
            rows = ({"path": path} for path in partition.items)
        else:
            rows = blobs_of(self.root, partition.items)
        held: list[dict] = []
        for row in rows:
            held.append(row)
            if len(held) == 2_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class HistorySource(DataSource):
    """format("source_history"), options path, table, ref and since_ref. The driver lists commit ids
    or paths; tasks ask git for the rest, so all machines must see the repository."""

    @classmethod
    def name(cls) -> str:
        return "source_history"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {SPARK_TYPES[f.type]}" for f in TABLES[self.options["table"]])

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(dict(self.options))


def history_table(spark: SparkSession, path: str, table: str, ref: str = "HEAD", since_ref: str | None = None) -> DataFrame:
    """A table of the repository that holds `path`, as of a ref: commits (commit_id, author, email,
    ts, n_parents), commit_files (commit_id, path, committed), hunks (ownership of the lines of
    source files) or files (path, language, content, as a scan of that tree would give). Paths are
    relative to the repository; files and hunks are those below `path`, and with `since_ref` only
    those that may have other owners than at that ref.

    Comparisons of ts, committed and path with constants reach git: commits outside a span of time
    and files outside a folder are not asked for. The session's filter pushdown for Python sources
    is turned on for that; it concerns only sources that take filters.
    """
    spark.dataSource.register(HistorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    repository(path)
    out = spark.read.format("source_history").option("path", os.path.abspath(path)).option("table", table).option("ref", ref)
    return (out.option("since_ref", since_ref) if since_ref else out).load()


def kept_hunks(spark: SparkSession, path: str, folder: str, ref: str = "HEAD") -> DataFrame:
    """The hunks below `path` at a ref, from those that earlier calls left in `folder` (one that all
    machines share): git is asked only about files whose lines may have other owners since.

    Every call whose commit has no table yet writes one (commits are named, not refs) and then its
    line in the index, so a run that is lost leaves the index as it was and the next one asks anew.
    Of several tables the latest serves. Rows equal those of history_table(spark, path, "hunks", ref).
    """
    root, prefix = repository(path)
    new = commit_of(root, ref)
    own = f"{folder}/{hashlib.sha256(f'{root}:{prefix}'.encode()).hexdigest()[:16]}"
    ask = partial(history_table, spark, path, ref=new)
    try:
        index = spark.read.schema("commit_id string, place string, at timestamp").json(f"{own}/index")
        last = index.orderBy(F.col("commit_id") == new, "at").tail(1)[0]
        old, kept = last["commit_id"], spark.read.parquet(last["place"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = kept = None  # the first call, or the table was cleared away
    if old == new:
        return kept
    changed = touched(root, old, new) if old else None
    if changed is None:
        hunks = ask("hunks")
    else:
        hunks = kept.join(ask("touched", since_ref=old), "path", "left_anti").unionByName(ask("hunks", since_ref=old))
    place = f"{own}/{new}-{datetime.now().timestamp():.6f}"
    hunks.write.parquet(place)
    spark.sql("SELECT :commit_id AS commit_id, :place AS place, current_timestamp() AS at", args={"commit_id": new, "place": place}).coalesce(1).write.mode("append").json(f"{own}/index")
    return spark.read.parquet(place)
