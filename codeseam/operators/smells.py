"""Smells of source files: magic numbers, debt words, commented-out code, long functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import masked, todo_debt
from .rules import RULES

#: First words of declarations, numbers that are not magic, and what code contains.
DECLARES = ("const", "let", "static", "final", "val", "#define", "enum")
TRIVIAL = ("0", "1", "2", "-1")
STRONG = (";", "{", "}", "return ", "if(", "for(", "while(", "else{")
WEAK = ("if ", "for ", "while ", "else ", "let ", "var ", "const ", "fn ", "def ", "func ", "function ", "class ", "= ", "=>", "->")

#: A name, a number that runs into letters, or a number (group 1). A minus after either of them
#: is taken along, as it is no sign of what follows.
NUMBER = r"[A-Za-z_][A-Za-z0-9_]*-?|-?[0-9][0-9A-Fa-f._xXoO]*[G-NP-WYZg-np-wyz][A-Za-z0-9_]*-?|(-?[0-9][0-9A-Fa-f._xXoO]*)-?"
#: Comment marks at the start of a trimmed line.
MARKS = r"^(?:///)*(?://)*#*(?:--)*%*(?:/\*)*\**"


def has_magic_number(line: Column) -> Column:
    """Whether a masked line that declares nothing has a number other than the trivial ones."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    magic = F.exists(numbers, lambda n: (n != "") & ~F.regexp_replace(n, r"\.+$", "").isin(*TRIVIAL))
    return ~F.lower(F.regexp_extract(text, r"^\S*", 0)).isin(*DECLARES) & magic


def telling(lines: DataFrame) -> DataFrame:
    """The lines that may hold a smell: comments, and code with a digit. They are few, so what is
    read once for each kind of smell should be these, stored."""
    return lines.where((F.col("kind") == "Comment") | ((F.col("kind") == "Code") & F.col("text").rlike("[0-9]")))


def magic_numbers(lines: DataFrame) -> DataFrame:
    """(path, line_no) of code lines with a magic number, of languages with rules."""
    text = F.col("text")
    for mark in sorted({r.comment for r in RULES.values()}):
        text = F.when(F.col("language").isin([n for n, r in RULES.items() if r.comment == mark]), masked(F.col("text"), (mark,))).otherwise(text)
    return lines.where("kind = 'Code'").where(has_magic_number(text)).select("path", "line_no")


def looks_like_code(line: Column) -> Column:
    """Whether a comment line has a strong mark of code and at least two marks in all."""
    text = F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), MARKS, "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    hits = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    return (hits(STRONG) > 0) & (hits(STRONG) + hits(WEAK) >= 2)


def commented_out_code(lines: DataFrame) -> DataFrame:
    """(path, line_no, run): runs of two or more neighbouring comment lines that look like code."""
    code = lines.where("kind = 'Comment'").where(looks_like_code(F.col("text"))).select("path", "line_no")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    runs = code.withColumn("island", island).groupBy("path", "island").agg(F.min("line_no").alias("line_no"), F.count("*").alias("run"))
    return runs.where("run >= 2").select("path", "line_no", "run")


def long_functions(found: DataFrame, most: int = 50) -> DataFrame:
    """Functions whose code lines, less those of the frame (two with braces, else one), exceed
    `most`."""
    frame = F.when(F.col("language").isin([n for n, r in RULES.items() if r.braces]), 2).otherwise(1)
    return found.withColumn("size", F.col("code_lines") - frame).where((F.col("name") != "<file>") & (F.col("size") > most)).select("path", "start_line", "name", "size")


def long_parameters(found: DataFrame, most: int = 4) -> DataFrame:
    return found.where((F.col("name") != "<file>") & (F.col("n_params") > most)).select("path", "start_line", "name", F.col("n_params").alias("size"))


#: The kinds of smells, in the order of reports.
KINDS = ("magic_number", "long_function", "long_parameters", "debt", "commented_out_code")
#: Kind -> its name in JSON, its title.
TITLES = {"magic_number": ("magic_number", "Magic Number"), "long_function": ("long_function", "Long Function"), "long_parameters": ("long_parameter_list", "Long Parameter List"), "debt": ("todo_debt", "TODO/FIXME Debt"), "commented_out_code": ("commented_out_code", "Commented-Out Code")}


def smells(lines: DataFrame, found: DataFrame, max_lines: int = 50, max_params: int = 4) -> DataFrame:
    """(path, line_no, smell, detail): all kinds together."""
    parts = [
        (magic_numbers(lines), "line_no", F.lit("magic number in code")),
        (long_functions(found, max_lines), "start_line", F.format_string(f"function `%s` has %d lines (max {max_lines})", "name", "size")),
        (long_parameters(found, max_params), "start_line", F.format_string(f"function `%s` has %d params (max {max_params})", "name", "size")),
        (todo_debt(lines), "line_no", F.format_string("%s comment", "debt")),
        (commented_out_code(lines), "line_no", F.format_string("%d lines of commented-out code", "run")),
    ]
    each = [part.select("path", F.col(at).alias("line_no"), F.lit(kind).alias("smell"), detail.alias("detail")) for kind, (part, at, detail) in zip(KINDS, parts, strict=True)]
    return reduce(DataFrame.unionByName, each)


def listed(all_smells: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, total, smells): the smells (kind, line, detail) of the files of smell_counts() rows,
    by line and then by kind."""
    order = ("long_function", "long_parameters", "debt", "magic_number", "commented_out_code")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("smell"))
    kind = F.element_at(F.create_map(*(F.lit(x) for k, (name, _) in TITLES.items() for x in (k, name))), F.col("smell"))
    of = all_smells.join(counts.select("path", "total"), "path").groupBy("path", "total").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("line"), rank.alias("rank"), kind.alias("kind"), "detail"))).alias("s"))
    return of.select("path", "total", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["line"].alias("line"), x["detail"].alias("detail"))).alias("smells"))


def smell_counts(all_smells: DataFrame) -> DataFrame:
    """One row per file with a smell, one column per kind, and their sum."""
    return all_smells.groupBy("path").agg(*(F.count_if(F.col("smell") == k).alias(k) for k in KINDS), F.count("*").alias("total"))
