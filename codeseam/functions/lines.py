"""Lines of files and their kinds: Blank, Comment or Code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .languages import BY_NAME, Language


def split_lines(content: Column) -> Column:
    """Lines of a text without their ends (LF or CRLF); no line after a final end."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n", "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def plain_kind(line: Column, number: Column, markers: tuple[str, ...]) -> Column:
    """Kind of a line where no state crosses lines: languages with line comments at most."""
    left = F.regexp_replace(line, r"^[ \t\x0b\x0c\r]+", "")
    comment = F.lit(False)
    for m in markers:
        comment = comment | left.startswith(m)
    shebang = (number == 1) & line.startswith("#!")
    return F.when(shebang, "Code").when(F.regexp_like(line, F.lit(r"(?U)^\s*$")), "Blank").when(comment, "Comment").otherwise("Code")


@cache
def _special(lang: Language) -> re.Pattern:
    """What can begin a string, a comment or a pragma; a line without it is code or blank."""
    begins = ['"', "'", *lang.line, *(lang.block or ())[:1], *(lang.pragma or ())[:1]]
    return re.compile("|".join(map(re.escape, begins)))


@cache
def _marks(lang: Language) -> dict[str, re.Pattern]:
    """What is looked for inside each kind of string, and inside a block comment."""
    block = lang.block or ()
    inside = {q: re.compile(f"[{q}\\\\]") for q in "\"'"} | {3 * q: re.compile(3 * q) for q in "\"'"}
    return inside | {"block": re.compile("|".join(map(re.escape, block[:2] if lang.nested else block[1:2])))}


def kinds(lines: list[str], lang: Language) -> list[str]:
    """Kinds of a file's lines; strings in triple quotes and block comments cross lines.

    A line with any code is code, else with any comment a comment. A blank line inside a block
    comment belongs to it.
    """
    out, depth, quote = [], 0, ""
    special, marks = _special(lang), _marks(lang)
    for number, line in enumerate(lines):
        if number == 0 and line.startswith("#!"):
            out.append("Code")
            continue
        if not line.strip():
            out.append("Comment" if depth else "Blank")
            continue
        if not depth and not quote and not special.search(line):
            out.append("Code")
            continue
        code = comment = False
        i = 0
        while i < len(line):
            if depth:
                comment = True
                found = marks["block"].search(line, i)
                if not found:
                    break
                depth, i = depth + (1 if found[0] == lang.block[0] and lang.nested else -1), found.end()
            elif quote:
                code = True
                found = marks[quote].search(line, i)
                if not found:
                    break
                i, quote = (found.end() + 1, quote) if found[0] == "\\" else (found.end(), "")
            elif lang.triple and line[i : i + 3] in ('"""', "'''"):
                quote, code, i = line[i : i + 3], True, i + 3
            elif lang.pragma and line.startswith(lang.pragma[0], i):
                end = line.find(lang.pragma[1], i)
                code, i = True, len(line) if end < 0 else end + len(lang.pragma[1])
            elif lang.block and line.startswith(lang.block[0], i):
                depth, comment, i = 1, True, i + len(lang.block[0])
            elif any(line.startswith(m, i) and line[i + len(m) : i + len(m) + 1] not in (set(lang.not_before) or {None}) for m in lang.line):
                comment = True
                break
            elif line[i] == '"' or line[i] == "'" and lang.single:
                quote, code, i = line[i], True, i + 1
            else:
                # on to the next place where something can begin
                found = special.search(line, i + 1)
                end = found.start() if found else len(line)
                code, i = code or bool(line[i:end].strip()), end
        if len(quote) == 1:
            quote = ""
        out.append("Code" if code else "Comment" if comment else "Blank")
    return out


LINE = pa.schema([("path", pa.string()), ("language", pa.string()), ("line_no", pa.int64()), ("text", pa.string()), ("kind", pa.string())])
#: Characters of the texts whose lines are passed on together.
BATCH = 500_000


def lines_of(files: DataFrame) -> DataFrame:
    """(path, language, line_no, text, kind) of files (path, language, content).

    Languages without block comments and triple quotes stay in expressions; the others run file
    by file through Arrow, as state crosses their lines. Binary files (a NUL among the first 512
    characters) and files without a known language have no lines.
    """
    text = files.where(F.col("language").isin(*BY_NAME) & ~F.coalesce(F.substring("content", 1, 512).contains("\0"), F.lit(True)))
    plain = [x for x in BY_NAME.values() if not x.block and not x.triple and not x.pragma]
    numbered = text.where(F.col("language").isin([x.name for x in plain])).select("path", "language", F.posexplode(split_lines(F.col("content"))).alias("k", "text")).withColumn("line_no", (F.col("k") + 1).cast("long"))
    kind = F.lit("Code")
    for markers in sorted({x.line for x in plain}):
        kind = F.when(F.col("language").isin([x.name for x in plain if x.line == markers]), plain_kind(F.col("text"), F.col("line_no"), markers)).otherwise(kind)
    fast = numbered.select("path", "language", "line_no", "text", kind.alias("kind"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = ([], [], [], [], []), 0
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = content.removesuffix("\n").split("\n") if content else []
                n = len(lines)
                for column, more in zip(out, ([path] * n, [language] * n, range(1, n + 1), lines, kinds(lines, BY_NAME[language])), strict=True):
                    column.extend(more)
                size += len(content)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out, LINE.types)], schema=LINE)
                    out, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([*map(pa.array, out, LINE.types)], schema=LINE)

    slow = text.where(~F.col("language").isin([x.name for x in plain])).select("path", "language", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    return fast.unionByName(slow.mapInArrow(classify, "path string, language string, line_no long, text string, kind string"))
