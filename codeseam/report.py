"""Small results as text: tables, JSON, one line, annotations, code-quality entries, Markdown."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def pad(text: str, columns: int, right: bool = False) -> str:
    space = " " * max(0, columns - width(text))
    return space + text if right else text + space


def duration(seconds: float) -> str:
    """45s, 3m 20s, 2h 15m or 1d 4h."""
    s = int(seconds)
    for unit, size, next_, part in (("d", 86_400, "h", 3_600), ("h", 3_600, "m", 60), ("m", 60, "s", 1)):
        if s >= size:
            return f"{s // size}{unit} {s % size // part}{next_}"
    return f"{s}s"


def thousands(n: int) -> str:
    return f"{n:,}"


def escaped(text: str) -> str:
    """Text in a cell of a Markdown table."""
    return text.replace("\\", "\\\\").replace("|", "\\|")


def fingerprint(text: str) -> str:
    """FNV-1a of 64 bits, as 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def rows_of(report: DataFrame) -> list[dict]:
    """The rows of a report, which is small by its own limit."""
    return [r.asDict(recursive=True) for r in report.collect()]


def cell(value: Any) -> str:
    if isinstance(value, float):
        return f"{value:.2f}"
    if isinstance(value, (list, tuple)):
        return ", ".join(map(cell, value))
    return "" if value is None else str(value)


def table(title: str, rows: list[dict], columns: Iterable[str] | None = None) -> str:
    names = list(columns or (rows[0] if rows else ()))
    cells = [[cell(r.get(c)) for c in names] for r in rows]
    sizes = [max([width(n), *(width(line[i]) for line in cells)]) for i, n in enumerate(names)]
    right = [bool(rows) and all(isinstance(r.get(n), (int, float)) for r in rows) for n in names]
    line = lambda parts: " " + " ".join(pad(p, w, x) for p, w, x in zip(parts, sizes, right, strict=True)).rstrip()
    rule = "─" * (sum(sizes) + len(sizes) + 1)
    return "\n".join([title, rule, line(names), rule, *map(line, cells), rule])


def as_json(rows: Any) -> str:
    return json.dumps(rows, indent=2, default=str, ensure_ascii=False)


def markdown(title: str, rows: list[dict], columns: Iterable[str] | None = None) -> str:
    names = list(columns or (rows[0] if rows else ()))
    body = ["| " + " | ".join(escaped(cell(r.get(c))) for c in names) + " |" for r in rows]
    return "\n".join([f"## {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *body, ""])


def annotations(findings: list[dict], level: str = "warning") -> str:
    """Lines that a build service shows at the place: findings have path, line, title, message."""
    return "\n".join(f"::{level} file={f['path']},line={f['line']},title={f['title']}::{f['message']}" for f in findings)


def quality_entry(f: dict) -> dict:
    return {"description": f["message"], "fingerprint": fingerprint(f"{f['path']}:{f['line']}:{f['title']}"), "severity": f["severity"], "location": {"path": f["path"], "lines": {"begin": f["line"]}}}


def quality_entries(findings: list[dict]) -> str:
    """The same as code-quality entries, with a severity each."""
    return as_json([quality_entry(f) for f in findings])


def complexity_findings(functions: DataFrame, measure: str, least: int) -> DataFrame:
    """Functions whose complexity is `least` or more, as findings (path, line, title, message, severity)."""
    level = F.when(F.col(measure) >= 25, "critical").when(F.col(measure) >= 15, "major").when(F.col(measure) >= 10, "minor").otherwise("info")
    text = F.format_string(f"function '%s' has {measure} complexity %d (threshold: {least})", "name", measure)
    return functions.where(F.col(measure) >= least).orderBy("path", "start_line").select("path", F.col("start_line").alias("line"), F.lit(f"{measure.title()} Complexity").alias("title"), text.alias("message"), level.alias("severity"))


def sections(title: str, parts: list[tuple[str, str, DataFrame, int]]) -> list[dict]:
    """The sections of a report, from (name, description, rows in order, top): how many rows there
    are, and the first `top` of them."""
    return [{"title": title, "section": name, "description": text, "total_count": df.count(), "entries": rows_of(df.limit(top))} for name, text, df, top in parts]
