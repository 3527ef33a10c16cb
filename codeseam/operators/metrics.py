"""Per-file metrics: lines, indentation, complexity, tokens, maintainability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import level
from .rules import COGNITIVE_LEVELS, CYCLOMATIC_LEVELS

EDGE = "[A-Za-z0-9_]"
#: Strings, to their end or to the line's; possessive, so that no length overflows the stack.
DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)'
SINGLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?$)"


def quoted(word: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in word)


def masked(line: Column, comments: tuple[str, ...]) -> Column:
    """The line with the insides of strings blanked and what follows a comment marker removed.

    One ordered alternation decides at each place: a comment marker, then a string (to its end,
    or to the line's end if it has none).
    """
    marks = "|".join(quoted(m) for m in comments if m)
    out = F.regexp_replace(line, f"({DOUBLE}|{SINGLE})" + (f"|(?:{marks}).*$" if marks else ""), "$1") if marks else line
    return F.regexp_replace(F.regexp_replace(out, DOUBLE, '""'), SINGLE, "''")


def keyword_count(line: Column, word: str) -> Column:
    """Whole-word occurrences; a boundary is anything but an ASCII letter, digit or underscore."""
    return F.regexp_count(line, F.lit(f"(?<!{EDGE}){quoted(word)}(?!{EDGE})"))


def has_keyword(line: Column, word: str) -> Column:
    return line.rlike(f"(?<!{EDGE}){quoted(word)}(?!{EDGE})")


def loc(lines: DataFrame) -> DataFrame:
    """Blank, comment and code lines of each file."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return lines.groupBy("path", "language").agg(of("Blank").alias("blank"), of("Comment").alias("comment"), of("Code").alias("code"))


def loc_by_language(lines: DataFrame) -> DataFrame:
    """Files and lines by language, and a total row with a null language."""
    return loc(lines).rollup("language").agg(F.count("*").alias("files"), F.sum("blank").alias("blank"), F.sum("comment").alias("comment"), F.sum("code").alias("code"))


#: Lines of a file that meet its hunks together.
SPAN = 64


def loc_by_author(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """(email, name, files, blank, comment, code) from lines (path, line_no, kind) and hunks
    (path, start_line, n_lines, author, email, ts): every line counts for the author of the hunk
    that holds it. The name is that of the latest hunk.

    Hunks become one row per span of SPAN lines that they reach into, and lines meet those of their
    span. Both sides are dealt out by path and span: what a hunk becomes is much larger than the
    table it comes from, so it must not be taken for small and sent to the driver.
    """
    span = lambda c: F.floor(F.col(c) / SPAN)
    ends = hunks.where("n_lines > 0").select("path", "author", "email", "ts", F.col("start_line").cast("long").alias("first"), (F.col("start_line") + F.col("n_lines") - 1).cast("long").alias("last"))
    own = ends.withColumn("span", F.explode(F.sequence(span("first"), span("last"))))
    met = lines.select("path", "line_no", "kind", span("line_no").alias("span")).join(own.hint("merge"), ["path", "span"]).where("line_no between first and last")
    # one row for a file and author before the distinct files are counted
    of = lambda k: F.count_if(F.col("kind") == k)
    per_file = met.groupBy("email", "path").agg(F.max(F.struct("ts", "author")).alias("last"), of("Blank").alias("blank"), of("Comment").alias("comment"), of("Code").alias("code"))
    return per_file.groupBy("email").agg(F.max("last")["author"].alias("name"), F.count("*").alias("files"), F.sum("blank").alias("blank"), F.sum("comment").alias("comment"), F.sum("code").alias("code"))


def indent_metrics(measures: DataFrame) -> DataFrame:
    """Code lines, sample deviation (0 for one line), maximum and sum of indentation depths."""
    deviation = F.col("indent_stddev")
    out = measures.where("code > 0").select("path", F.col("code").alias("code_lines"), "indent_stddev", "indent_max", "total_indent")
    return out.withColumn("complexity", F.when(deviation < 1.0, "low").when(deviation < 1.5, "moderate").when(deviation < 2.0, "high").otherwise("very_high"))


def complexity(measures: DataFrame, measure: str = "cyclomatic", least: int = 1) -> DataFrame:
    """Functions, total, maximum, mean and level of a measure ("cyclomatic" or "cognitive") of each
    file that has it, with a maximum of `least` if that is over 1."""
    each = F.col(f"functions.{measure}")
    total, most = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.array_max(each)
    out = measures.where("functions is not null").select("path", "language", F.size("functions").cast("long").alias("functions"), total.alias("total"), most.alias("max"), (total / F.size("functions")).alias("avg"))
    bounds = CYCLOMATIC_LEVELS if measure == "cyclomatic" else COGNITIVE_LEVELS
    out = out.withColumn("level", level(F.col("max"), bounds, "extreme"))
    return out.where(F.col("max") >= least) if least > 1 else out


def function_levels(measure: str = "cyclomatic") -> Column:
    """The functions of a wide row with name, start_line, complexity and level."""
    bounds = CYCLOMATIC_LEVELS if measure == "cyclomatic" else COGNITIVE_LEVELS
    return F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["start_line"].alias("start_line"), f[measure].alias("complexity"), level(f[measure], bounds, "extreme").alias("level")))


def halstead(measures: DataFrame) -> DataFrame:
    """What follows from the token counts, of files that have operators and operands."""
    vocabulary = F.col("distinct_operators") + F.col("distinct_operands")
    length = F.col("total_operators") + F.col("total_operands")
    out = measures.where("distinct_operators is not null").select("path", "language", "distinct_operators", "distinct_operands", "total_operators", "total_operands")
    out = out.withColumn("vocabulary", vocabulary).withColumn("length", length).withColumn("volume", length * F.log2(vocabulary.cast("double")))
    out = out.withColumn("difficulty", F.col("distinct_operators") / 2.0 * F.col("total_operands") / F.col("distinct_operands"))
    return out.withColumn("effort", F.col("difficulty") * F.col("volume")).withColumn("bugs", F.col("volume") / 3000.0).withColumn("time", F.col("effort") / 18.0)


def raw_index(volume: Column, total: Column, code: Column) -> Column:
    safe = lambda x: F.ln(F.greatest(x.cast("double"), F.lit(1.0)))
    return F.lit(171.0) - 5.2 * safe(volume) - 0.23 * total - 16.2 * safe(code)


def mi_visual_studio(volume: Column, total: Column, code: Column) -> Column:
    """0 to 100."""
    return F.greatest(F.lit(0.0), raw_index(volume, total, code) * 100.0 / 171.0)


def comment_percent(code: Column, comment: Column) -> Column:
    return F.when(code + comment > 0, comment * 100.0 / (code + comment)).otherwise(0.0)


def mi_verifysoft(volume: Column, total: Column, code: Column, comment: Column) -> tuple[Column, Column, Column]:
    """(index without comments, comment weight, sum)."""
    bare, weight = raw_index(volume, total, code), 50.0 * F.sin(F.sqrt(2.46 * F.radians(comment_percent(code, comment))))
    return bare, weight, bare + weight


def all_measures(measures: DataFrame) -> DataFrame:
    """The wide rows with token metrics, complexities and both indexes as columns of their own,
    null where a file has none. All of it follows row by row: no join and no shuffle."""
    each = {m: F.col(f"functions.{m}") for m in ("cyclomatic", "cognitive")}
    out = measures.withColumns({f"total_{m}": F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y) for m, x in each.items()} | {f"max_{m}": F.array_max(x) for m, x in each.items()})
    vocabulary = (F.col("distinct_operators") + F.col("distinct_operands")).cast("double")
    out = out.withColumn("volume", (F.col("total_operators") + F.col("total_operands")) * F.log2(vocabulary))
    out = out.withColumn("effort", F.col("distinct_operators") / 2.0 * F.col("total_operands") / F.col("distinct_operands") * F.col("volume"))
    v, c, m = (F.col(n) for n in ("volume", "code", "comment"))
    bare, weight, full = mi_verifysoft(v, F.coalesce("total_cyclomatic", F.lit(1)), c, m)
    indexes = {"mi_score": mi_visual_studio(v, F.col("total_cyclomatic"), c), "mi_woc": bare, "mi_cw": weight, "miv_score": full}
    return out.withColumns({k: F.when(v.isNotNull(), x) for k, x in indexes.items()})


def maintainability(measures: DataFrame) -> DataFrame:
    """Both indexes of the files that have tokens and functions."""
    vs, full = F.col("mi_score"), F.col("miv_score")
    out = all_measures(measures).where("volume is not null and total_cyclomatic is not null")
    return out.select("path", "language", "volume", F.col("total_cyclomatic").alias("total_complexity"), "code", "comment", vs, F.when(vs >= 20, "green").when(vs >= 10, "yellow").otherwise("red").alias("mi_level"), "mi_woc", "mi_cw", full, F.when(full >= 85, "good").when(full >= 65, "moderate").otherwise("difficult").alias("miv_level"))


#: Words that mark a debt, in order of trial.
DEBTS = ["TODO", "FIXME", "HACK", "XXX", "BUG"]


def todo_debt(lines: DataFrame) -> DataFrame:
    """Comment lines with a debt word, the first that occurs in the upper-cased text."""
    up, kind = F.upper("text"), F.lit(None).cast("string")
    for word in reversed(DEBTS):
        kind = F.when(up.contains(word), word).otherwise(kind)
    return lines.where("kind = 'Comment'").select("path", "line_no", kind.alias("debt")).where("debt is not null")
