"""All measures of a file from one reading of it: one wide row per file, without a shuffle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.languages import BY_NAME
from ..functions.lines import kinds
from .rules import RULES, TOKENS, Rules, Tokens
from .structure import file_functions, indent, masked_lines, words_of

FUNCTION = pa.struct([("name", pa.string()), *((n, pa.int64()) for n in ("start_line", "n_lines", "code_lines", "n_params", "cyclomatic", "cognitive"))])
LONG = pa.int64()
BASE = [("path", pa.string()), ("language", pa.string()), ("error", pa.string()), ("blank", LONG), ("comment", LONG), ("code", LONG)]
#: What a reading can measure besides the lines by kind, with the columns it fills.
PARTS = {
    "indent": [("indent_stddev", pa.float64()), ("indent_max", LONG), ("total_indent", LONG)],
    "tokens": [("distinct_operators", LONG), ("distinct_operands", LONG), ("total_operators", LONG), ("total_operands", LONG)],
    "functions": [("functions", pa.list_(FUNCTION))],
    "windows": [("n_normalized", LONG), ("line_nos", pa.list_(pa.int32())), ("window_h", pa.list_(LONG)), ("window_g", pa.list_(LONG))],
}
ALL = tuple(PARTS)
#: A line that is this, trimmed, begins the tests of a file, whatever its language.
TESTS_BEGIN = "#[cfg(test)]"


def decoded(content: bytes | str, lenient: bool) -> list[str] | None:
    """Lines without their ends; None for a binary file (a NUL among the first 512 bytes). Bytes
    that are no UTF-8 are an error or, if lenient, their line is left out."""
    raw = content.encode() if isinstance(content, str) else bytes(content)
    if b"\0" in raw[:512]:
        return None
    if not raw:
        return []
    if lenient:
        out = []
        for line in raw.removesuffix(b"\n").split(b"\n"):
            try:
                out.append(line.removesuffix(b"\r").decode())
            except UnicodeDecodeError:
                continue
        return out
    return raw.decode().replace("\r\n", "\n").removesuffix("\n").split("\n")


def string_interiors(lines: list[str]) -> set[int]:
    """Numbers of the lines that begin and end inside a string in triple quotes."""
    out, quote = set(), ""
    if not any('"' * 3 in x or "'" * 3 in x for x in lines):
        return out
    token = re.compile(r"""\"""|'''|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?$)""")
    for k, line in enumerate(lines):
        began, at = bool(quote), 0
        while at < len(line):
            if quote:
                end = re.compile(rf"(?:[^\\]|\\.)*?{quote}").match(line, at)
                if not end:
                    break
                at, quote = end.end(), ""
            else:
                found = token.search(line, at)
                if not found:
                    break
                at = found.end()
                quote = found[0] if len(found[0]) == 3 and found[0] in ('"' * 3, "'" * 3) else ""
        if began and quote:
            out.add(k)
    return out


@cache
def token_rules(rules: Tokens) -> tuple[re.Pattern, bytes, list[bytes], list[bytes]]:
    """What finds symbols, a table that leaves the characters of symbols and blanks all others,
    the ignored words and the keywords."""
    chars = "".join(rules.symbols).encode()
    ignored, keywords = ([x.encode() for x in dict.fromkeys(of)] for of in (rules.ignored, rules.keywords))
    return re.compile(b"|".join(re.escape(x.encode()) for x in rules.symbols) or b"(?!)"), bytes(c if c in chars else 32 for c in range(256)), ignored, keywords


def token_counts(masks: list[str], rules: Tokens) -> tuple[int, int, int, int] | None:
    """(distinct operators, distinct operands, all operators, all operands); None without both."""
    # no symbol has what a word has; runs of characters of symbols are few, and looked into once
    text = "\n".join(masks).encode()
    words, symbols, (pattern, table, ignored, keywords) = Counter(words_of(text)), Counter(), token_rules(rules)
    for run, n in Counter(text.translate(table).split()).items():
        for t in pattern.findall(run):
            symbols[t] += n
    for t in ignored:
        words.pop(t, None)
        symbols.pop(t, None)
    own = [n for t in keywords if (n := words.pop(t, 0))]
    ops, all_ops = len(own) + len(symbols), sum(own) + symbols.total()
    return (ops, len(words), all_ops, words.total()) if ops and words else None


#: Odd bases of the polynomials of windows, modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


@cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def window_keys(texts: list[str], window: int) -> list[np.ndarray]:
    """Two 64-bit keys of every run of `window` texts: polynomials of the texts' 128-bit digests,
    from sums over all of them, so that a window costs the same however long it is."""
    n = len(texts) - window + 1
    if n < 1:
        return [np.empty(0, np.int64)] * 2
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode()) for t in texts), ">u8").reshape(-1, 2).astype(np.uint64)
    room, out = 1 << max(10, len(texts).bit_length()), []
    for k, base in enumerate(BASES):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests[:, k] * powers(base, room)[: len(texts)])])
        key = (sums[window:] - sums[:n]) * powers(INVERSES[k], room)[:n]
        out.append((key ^ (key >> np.uint64(29))).view(np.int64))
    return out


def measured(path: str, language: str, content: bytes | str, window: int, strip_tests: bool, lenient: bool, parts: tuple[str, ...] = ALL) -> dict | None:
    """The wide row of a file with the parts asked for; None for a binary one."""
    spec, rules = BY_NAME[language], RULES.get(language)
    lines = decoded(content, lenient)
    if lines is None:
        return None
    of = kinds(lines, spec)
    code = [k for k, kind in enumerate(of) if kind == "Code"]
    row = {"path": path, "language": language, "blank": of.count("Blank"), "comment": of.count("Comment"), "code": len(code)}
    if code and "indent" in parts:
        depth = np.array([indent(lines[k]) // 4 for k in code])
        row |= {"indent_stddev": float(depth.std(ddof=1)) if depth.any() and len(code) > 1 else 0.0, "indent_max": int(depth.max()), "total_indent": int(depth.sum())}
    with_tokens, with_functions = language in TOKENS and "tokens" in parts, bool(rules) and "functions" in parts
    mask_rules = rules or Rules((), (), (), (), (), comment=spec.line[0] if spec.line else "")
    masks = masked_lines([lines[k] for k in code], mask_rules) if with_tokens or with_functions else []
    if with_tokens:
        inside = string_interiors(lines) if spec.triple else ()
        if counts := token_counts([m for k, m in zip(code, masks, strict=True) if k not in inside], TOKENS[language]):
            row |= dict(zip(("distinct_operators", "distinct_operands", "total_operators", "total_operands"), counts, strict=True))
    if with_functions and code:
        row["functions"] = [dict(zip(FUNCTION.names, f, strict=True)) for f in file_functions(lines, code, masks, rules)]
    if "windows" in parts:
        stop = next((k for k, x in enumerate(lines) if x.strip() == TESTS_BEGIN), len(lines)) if strip_tests else len(lines)
        own = [k for k in code if k < stop]
        h, g = window_keys([lines[k].strip() for k in own], window)
        row |= {"n_normalized": len(own), "line_nos": [k + 1 for k in own], "window_h": h.tolist(), "window_g": g.tolist()}
    return row


def file_measures(files: DataFrame, window: int = 6, strip_tests: bool = False, lenient: bool = False, parts: tuple[str, ...] = ALL) -> DataFrame:
    """One wide row per file of files (path, language, content as string or binary): lines by kind
    and, of PARTS, those asked for: indentation, token counts, functions with both complexities, and
    keys of every window of `window` normalized code lines (from the first test block on, if
    strip_tests, none). Only these are computed and are columns. Callers that read the rows more
    than once store them first.

    Null contents, unknown languages and binary files give no row. A file that cannot be read gives
    a row with its error and nulls, and does not end the job. Measures that a language has no rules
    for are null.
    """

    schema = pa.schema([*BASE, *(c for k, columns in PARTS.items() if k in parts for c in columns)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for path, language, content in zip(*(c for c in batch.columns), strict=True):
                path, language, content = path.as_py(), language.as_py(), content.as_py()
                try:
                    row = measured(path, language, content, window, strip_tests, lenient, parts)
                except (UnicodeError, RecursionError, ValueError) as e:
                    row = {"path": path, "language": language, "error": f"{type(e).__name__}: {e}"}
                if row:
                    out.append(row)
                    size += len(content)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    known = files.where(F.col("language").isin(*BY_NAME) & F.col("content").isNotNull())
    return known.select("path", "language", "content").mapInArrow(rows, from_arrow_schema(schema))


def functions(measures: DataFrame) -> DataFrame:
    """One row per function: path, language, name, start_line, n_lines, code_lines, n_params,
    cyclomatic, cognitive."""
    return measures.select("path", "language", F.explode("functions").alias("f")).select("path", "language", "f.*")
