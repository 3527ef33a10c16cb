"""The language registry and language detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    nested: bool = False
    single: bool = False  #: '...' is a string
    triple: bool = False
    shebangs: tuple[str, ...] = ()
    pragma: tuple[str, str] | None = None
    not_before: str = ""  #: characters after which a line marker is no comment


def _of(name, ext="", line="", block="", nested=False, single=False, triple=False, shebangs="", files="", **more) -> Language:
    markers = (line,) if line else ()
    return Language(name, tuple(ext.split()), tuple(files.split()), more.pop("lines", markers), tuple(block.split()) if block else None, nested, single, triple, tuple(shebangs.split()), **more)


#: Names, extensions, file names, comment markers and shebangs.
LANGUAGES = [
    _of("Rust", "rs", "//", "/* */", nested=True),
    _of("Python", "py pyi", "#", single=True, triple=True, shebangs="python python3"),
    _of("JavaScript", "js mjs cjs", "//", "/* */", single=True, shebangs="node"),
    _of("TypeScript", "ts mts cts", "//", "/* */", single=True),
    _of("Java", "java", "//", "/* */"),
    _of("C", "c h", "//", "/* */"),
    _of("C++", "cpp cxx cc hpp hxx", "//", "/* */"),
    _of("C#", "cs", "//", "/* */"),
    _of("Go", "go", "//", "/* */"),
    _of("Ruby", "rb", "#", single=True, shebangs="ruby", files="Rakefile Gemfile"),
    _of("Bourne Shell", "sh", "#", single=True, shebangs="sh"),
    _of("Bourne Again Shell", "bash", "#", single=True, shebangs="bash"),
    _of("Zsh", "zsh", "#", single=True, shebangs="zsh"),
    _of("HTML", "html htm", block="<!-- -->", single=True),
    _of("CSS", "css", block="/* */", single=True),
    _of("SQL", "sql", "--", "/* */", single=True),
    _of("TOML", "toml", "#"),
    _of("YAML", "yaml yml", "#"),
    _of("JSON", "json"),
    _of("Markdown", "md markdown"),
    _of("Kotlin", "kt kts", "//", "/* */", nested=True),
    _of("Swift", "swift", "//", "/* */", nested=True),
    _of("PHP", "php", "//", "/* */", single=True),
    _of("Dart", "dart", "//", "/* */", single=True),
    _of("Haskell", "hs", "--", "{- -}", nested=True, pragma=("{-#", "#-}"), not_before="!#$%&*+./<=>?@\\^|~"),
    _of("Lua", "lua", "--", "--[[ ]]", single=True, shebangs="lua"),
    _of("Perl", "pl pm", "#", single=True, shebangs="perl"),
    _of("R", "r R", "#", single=True, shebangs="Rscript"),
    _of("Scala", "scala sc sbt", "//", "/* */", nested=True),
    _of("XML", "xml xsl xslt svg fsproj csproj vbproj vcxproj sln plist xaml", block="<!-- -->", single=True),
    _of("Dockerfile", line="#", files="Dockerfile"),
    _of("Makefile", "mk", "#", files="Makefile makefile GNUmakefile"),
    _of("Elixir", "ex", "#", single=True, shebangs="elixir"),
    _of("Elixir Script", "exs", "#", single=True),
    _of("Clojure", "clj cljs cljc edn", ";"),
    _of("Zig", "zig", "//"),
    _of("Kaikai", "kai", "#", triple=True),
    _of("Objective-C", "m mm", "//", "/* */"),
    _of("OCaml", "ml mli", block="(* *)", nested=True),
    _of("F#", "fs fsi fsx", "//", "(* *)", nested=True),
    _of("Nim", "nim", "#", "#[ ]#", nested=True),
    _of("Julia", "jl", "#", "#= =#", nested=True, shebangs="julia"),
    _of("Terraform", "tf", "#", "/* */"),
    _of("Groovy", "groovy", "//", "/* */", single=True),
    _of("Gradle", "gradle", "//", "/* */", single=True),
    _of("Erlang", "erl hrl", "%"),
    _of("HTML EEx", "heex", block="<!-- -->", single=True),
    _of("PO File", "po pot", "#"),
    _of("DOS Batch", "bat cmd", lines=("::", "rem ", "REM ", "Rem ")),
    _of("Properties", "properties", "#"),
    _of("Text", "txt"),
]
BY_NAME = {x.name: x for x in LANGUAGES}


def _first(pairs: list[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


BY_FILE = _first([(f, x.name) for x in LANGUAGES for f in x.files])
BY_EXTENSION = _first([(e, x.name) for x in LANGUAGES for e in x.extensions])


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one or if the name starts with it."""
    name = base_name(path)
    return F.when(F.regexp_like(name, F.lit(r"^.+\.")), F.substring_index(name, ".", -1))


def detected(path: Column) -> Column:
    """Language by exact file name, then by extension (case-sensitive); else null."""
    return F.coalesce(_lookup(BY_FILE, base_name(path)), _lookup(BY_EXTENSION, extension(path)))


def by_shebang(line: str | None) -> str | None:
    """Language of a first line `#!...`: equal to or starting with a known interpreter."""
    if not line or not line.startswith("#!"):
        return None
    parts = line[2:].split()
    if not parts:
        return None
    name = parts[0].rsplit("/", 1)[-1]
    if name == "env":
        name = next((p for p in parts[1:] if not p.startswith("-")), "")
    for x in LANGUAGES:
        if any(name == s or name.startswith(s) for s in x.shebangs):
            return x.name
    return None
