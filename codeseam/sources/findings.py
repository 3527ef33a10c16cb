"""Findings written by tasks: annotations, code-quality entries or JSON lines, a file per partition."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..report import annotations, quality_entry

#: kind -> (ending of the files, text before, between and after the entries, text of a finding)
KINDS = {
    "annotations": ("txt", "", "\n", "\n", lambda f: annotations([f])),
    "quality": ("json", "[\n", ",\n", "\n]\n", lambda f: json.dumps(quality_entry(f), ensure_ascii=False)),
    "lines": ("jsonl", "", "\n", "\n", lambda f: json.dumps(f, ensure_ascii=False, default=str)),
}


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class FindingsWriter(DataSourceWriter):
    """Each attempt of a task writes a file of its own aside; the commit moves those that Spark
    accepted into the folder, so lost, repeated and failed attempts leave nothing there."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.kind, self.overwrite = options["path"], options.get("kind", "lines"), overwrite
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        self.job = uuid.uuid4().hex[:12]
        self.aside = f"{self.folder}/_{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        ending, before, between, after, text = KINDS[self.kind]
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.{ending}"
        os.makedirs(self.aside, exist_ok=True)
        attempt = f"{task.taskAttemptId()}-{name}"
        n = 1
        with open(f"{self.aside}/{attempt}", "w", encoding="utf-8") as f:
            f.write(before + text(first.asDict(recursive=True)))
            for row in iterator:
                f.write(between + text(row.asDict(recursive=True)))
                n += 1
            f.write(after)
        return Written(attempt, n)

    def parts(self) -> list[str]:
        return [x for x in os.listdir(self.folder) if x.startswith("part-") or x == "_SUCCESS"]

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for name in self.parts():
                os.remove(f"{self.folder}/{name}")
        for m in messages:
            if m and m.name:
                os.replace(f"{self.aside}/{m.name}", f"{self.folder}/{m.name.partition('-')[2]}")
        self.abort(messages)
        with open(f"{self.folder}/_SUCCESS", "w", encoding="utf-8") as f:
            f.write(f"{sum(m.rows for m in messages if m)}\n")

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.isdir(self.aside):
            for name in os.listdir(self.aside):
                os.remove(f"{self.aside}/{name}")
            os.rmdir(self.aside)


class FindingsSink(DataSource):
    """format("findings"), options path (a folder that all machines share) and kind."""

    @classmethod
    def name(cls) -> str:
        return "findings"

    def writer(self, schema, overwrite: bool) -> FindingsWriter:
        return FindingsWriter(dict(self.options), overwrite)


def write_findings(findings: DataFrame, folder: str, kind: str, mode: str = "overwrite") -> int:
    """Writes findings (path, line, title, message, severity) in their order to part files of a
    folder, each whole by itself (a list, for `quality`), and gives their number. Without rows there
    is no part. The rows go from tasks to files; the driver only moves files."""
    findings.sparkSession.dataSource.register(FindingsSink)
    findings.write.format("findings").option("path", os.path.abspath(folder)).option("kind", kind).mode(mode).save()
    with open(f"{folder}/_SUCCESS", encoding="utf-8") as f:
        return int(f.read())
