"""Edges between source files: what they import of each other."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import decoded

RUST = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_][A-Za-z0-9_]*)\s*;", re.M)
PYTHON = re.compile(r"^\s*from\s+(\.+)([A-Za-z0-9_.]*)\s+import\s+\(?([^#\n]*)", re.M)
SCRIPT = re.compile(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["'](\.{1,2}/[^"'\n]*)["']""")
GO = re.compile(r'"([^"\n]+)"')
GO_IMPORTS = re.compile(r'^\s*import\s+(?:\(([^)]*)\)|(?:[A-Za-z0-9_.]+\s+)?("[^"\n]+"))', re.M)
#: Tried in this order after the name that a script gives.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")


def candidates(path: str, language: str, text: str) -> Iterator[tuple[int, int, str]]:
    """(number of the import, place, path): where an import's file may be, the first there counts.
    Of Go packages, place is -1 and the path a folder whose files all count; it is still relative
    to the module."""
    folder, name = posixpath.split(path)
    stem = name.rpartition(".")[0]
    at = lambda *parts: posixpath.normpath(posixpath.join(folder, *parts))
    if language == "Rust":
        own = () if stem in ("main", "lib", "mod") else (stem,)
        for k, m in enumerate(RUST.finditer(text)):
            yield k, 0, at(*own, m[1] + ".rs")
            yield k, 1, at(*own, m[1], "mod.rs")
    elif language == "Python":
        k = 0
        for m in PYTHON.finditer(text):
            up, module = [".."] * (len(m[1]) - 1), m[2].split(".") if m[2] else []
            names = [[]] if module else [[n.split()[0]] for n in m[3].strip(" ()\\").split(",") if n.split()]
            for more in names:
                base = at(*up, *module, *more)
                yield k, 0, base + ".py"
                yield k, 1, base + "/__init__.py"
                k += 1
    elif language in ("JavaScript", "TypeScript"):
        for k, m in enumerate(SCRIPT.finditer(text)):
            base = at(m[1])
            yield from ((k, i, base + ending) for i, ending in enumerate(SCRIPT_ENDINGS))
            if base.endswith(".js"):  # as TypeScript writes it
                yield k, len(SCRIPT_ENDINGS), base[:-3] + ".ts"
    elif language == "Go":
        imports = [x for m in GO_IMPORTS.finditer(text) for x in GO.findall(m[1] or m[2])]
        yield from ((k, -1, x) for k, x in enumerate(imports))


def import_edges(files: DataFrame, go_module: str | None = None) -> DataFrame:
    """Distinct edges (src, dst) between files (path, language, content): `mod x;` of Rust, relative
    imports of Python, JavaScript and TypeScript, and, with the module's path, imports of Go.

    What is not among the files is left out, and so is a file's import of itself. Candidates meet
    the files by path, a key that is never hot but for a package that very many files import.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, content in zip(*batch.columns, strict=True):
                path, language = path.as_py(), language.as_py()
                try:
                    lines = decoded(content.as_py(), lenient=True) or []
                except ValueError:
                    continue
                if found := list(candidates(path, language, "\n".join(lines))):
                    ks, places, paths = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ks)), pa.array(ks, pa.int32()), pa.array(places, pa.int32()), pa.array(paths)], ["src", "k", "place", "path"])

    known = files.where(F.col("language").isin("Rust", "Python", "JavaScript", "TypeScript", "Go") & F.col("content").isNotNull())
    wanted = known.select("path", "language", "content").mapInArrow(rows, "src string, k int, place int, path string")
    there = files.select("path").distinct()
    met = wanted.where("place >= 0").join(there, "path")
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("src", "k").orderBy("place"))).where("r = 1").select("src", F.col("path").alias("dst"))
    if go_module:
        folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise("")
        packages = there.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(F.col("path").alias("dst"), folder(F.col("path")).alias("folder"))
        inside = F.when(F.col("path") == go_module, "").when(F.col("path").startswith(go_module + "/"), F.substr("path", F.lit(len(go_module) + 2)))
        first = first.unionByName(wanted.where("place < 0").select("src", inside.alias("folder")).join(packages, "folder").select("src", "dst"))
    return first.where("src <> dst").distinct()
