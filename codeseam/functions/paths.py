"""Predicates on paths: test files, generated files, exclusions with their reasons."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders of tests, and (extensions, suffixes, prefixes) of test files' stems.
TEST_DIRS = ("tests", "test", "__tests__", "spec")
TEST_NAMES = [
    ("rs go exs dart", "_test", ""),
    ("py", "_test", "test_"),
    ("rb", "_test _spec", ""),
    ("php", "Test _test", ""),
    ("js jsx mjs cjs ts tsx mts cts", ".test .spec", ""),
    ("java kt kts cs swift", "Test Tests", ""),
    ("scala", "Test Spec", ""),
    ("c", "_test _unittest", "test_"),
    ("cc cpp cxx", "_test _unittest Test", "test_"),
    ("hs", "Test Spec", ""),
]
#: Lock files, and endings of generated files.
LOCKS = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock", "composer.lock", "Pipfile.lock", "go.sum")
GENERATED = (".min.js", ".min.css", ".bundle.js", ".pb.go", "_pb2.py")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def test_name_pattern() -> str:
    """One expression for all naming rules, matched against a whole file name."""

    def either(words: str) -> str:
        return "|".join(map(re.escape, words.split()))

    rules = []
    for exts, suffixes, prefixes in TEST_NAMES:
        stems = [f".*(?:{either(suffixes)})"] + ([f"(?:{either(prefixes)}).*"] if prefixes else [])
        rules.append(f"(?:{'|'.join(stems)})\\.(?:{either(exts)})")
    return f"^(?:{'|'.join(rules)})$"


def is_test_file(path: Column) -> Column:
    return F.regexp_like(file_name(path), F.lit(test_name_pattern()))


def in_folder(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder of the path, at any depth, has one of these names."""
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, names)).cast("array<string>"))


def is_test_path(path: Column) -> Column:
    return is_test_file(path) | in_folder(path, TEST_DIRS)


def is_generated(path: Column) -> Column:
    name = file_name(path)
    out = name.isin(*LOCKS) | name.contains(".generated.")
    for ending in GENERATED:
        out = out | name.endswith(ending)
    return out


def glob_pattern(glob: str) -> str:
    """A glob as an expression over a whole path; stars and question marks cross slashes, braces
    hold alternatives. A glob with an open bracket or brace is an error."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "[":
            close = glob.find("]", i + 2)
            if close < 0:
                raise ValueError(f"invalid glob {glob!r}: unclosed character class")
            inside = glob[i + 1 : close].replace("\\", r"\\")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
            i = close + 1
            continue
        if c in "{}" or (c == "," and braces):
            braces += (c == "{") - (c == "}")
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    if braces:
        raise ValueError(f"invalid glob {glob!r}: unbalanced braces")
    return f"^{out}$"


def valid_globs(globs: tuple[str, ...]) -> list[str]:
    """The expressions of the globs that are valid; of others, a warning each."""
    out = []
    for g in globs:
        try:
            out.append(glob_pattern(g))
        except ValueError as e:
            warnings.warn(str(e), stacklevel=2)
    return out


@dataclass(frozen=True)
class Exclusions:
    """Which files a scan leaves out. With `only` extensions, files of others are left out."""

    extensions: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    tests: bool = False

    @staticmethod
    def plain(extensions: tuple[str, ...]) -> list[str]:
        return [x for e in extensions if (x := e.lstrip(".").lower())]

    def reasons(self, path: Column) -> Column:
        """Why a path is left out, comma-separated; empty if it is not."""
        dot = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
        ext, never = F.lower(dot), F.lit(False)
        by_ext = ~ext.isin(self.plain(self.only)) if self.plain(self.only) else ext.isin(self.plain(self.extensions)) if self.plain(self.extensions) else never
        by_glob = never
        for pattern in valid_globs(self.globs):
            by_glob = by_glob | F.regexp_like(path, F.lit(pattern))
        found = [
            (is_test_file(path) if self.tests else never, "test file"),
            (by_ext, "extension"),
            (in_folder(path, self.folders) if self.folders else never, "directory"),
            (in_folder(path, TEST_DIRS) if self.tests else never, "test directory"),
            (by_glob, "glob"),
        ]
        return F.concat_ws(", ", *(F.when(test, name) for test, name in found))

    def keeps(self, path: Column) -> Column:
        return self.reasons(path) == ""
