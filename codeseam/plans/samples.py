"""Made-up source files, one for each part, of which all measures follow from the part's numbers.

The SQL beside a query states the measures from the numbers alone, so it shares nothing with the
code that reads the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import BY_NAME

#: Languages by part number, and what their functions begin with.
LANGUAGES = {"Rust": "fn ", "Python": "def ", "Go": "func ", "JavaScript": "function "}
BLOCK = "    if x && y || z {\n        for i in v {\n            run(17, i);\n        }\n    } else {\n        stop();\n    }\n"
PYTHON_BLOCK = "    if x and y or z:\n        for i in v:\n            run(17, i)\n    else:\n        stop()\n"


def sources(parts: DataFrame) -> DataFrame:
    """(path, language, content, and p, functions, blocks, calls, params as integers).

    A file has p % 3 functions. Each has a string with marker words, `blocks` nested blocks with a
    number, `calls` plain lines and `params` parameters; around them are comments of all kinds.
    """
    p, z = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), p % len(xs) + 1)
    base = parts.select(p.alias("p"), (p % 3).alias("functions"), (z % 4).alias("blocks"), (z * 3 % 70).alias("calls"), (z % 7).alias("params"), pick(list(LANGUAGES)).alias("language"), pick(list(LANGUAGES.values())).alias("start"))
    extension = F.element_at(F.create_map(*(F.lit(x) for n in LANGUAGES for x in (n, BY_NAME[n].extensions[0]))), F.col("language"))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    names = F.array_join(F.transform(numbers(F.col("params")), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
    head = lambda i: F.concat("start", F.lit("f"), i.cast("string"), F.lit("("), names)
    times = lambda text, c: F.repeat(F.lit(text), F.col(c))
    brace = F.transform(numbers(F.col("functions")), lambda i: F.concat(head(i), F.lit(') {\n    let s = "if && // no";\n'), times(BLOCK, "blocks"), times("    call(i);\n", "calls"), F.lit("}\n\n")))
    python = F.transform(numbers(F.col("functions")), lambda i: F.concat(head(i), F.lit('):\n    """doc\n    if inside\n    """\n'), times(PYTHON_BLOCK, "blocks"), times("    call(i)\n", "calls"), F.lit("\n")))
    is_python = F.col("language") == "Python"
    mark = F.when(is_python, "#").otherwise("//")
    debt = F.when(F.col("p") % 5 == 0, " TODO").otherwise("")
    first = F.concat(mark, F.lit(" part "), F.col("p").cast("string"), debt, F.lit("\n\n"), F.when(is_python, "").otherwise("/* start\n\nend */\n"))
    plain = F.when(F.col("functions") > 0, "").when(is_python, "run(a and b)\n").otherwise("run(a && b);\n")
    tail = F.when(F.col("p") % 2 == 0, F.concat(mark, F.lit(" return a;\n"), mark, F.lit(" if (b) { }\n"))).otherwise("")
    content = F.concat(first, F.array_join(F.when(is_python, python).otherwise(brace), ""), plain, tail)
    path = F.concat(F.lit("src/m"), F.col("p").cast("string"), F.lit("."), extension)
    return base.select(path.alias("path"), "language", content.alias("content"), "p", "functions", "blocks", "calls", "params")


#: The numbers of every file, and what follows from them for a function (length, complexities) and
#: a file (lines by kind).
SQL = """WITH q AS (SELECT p_partkey AS p, p_partkey % 3 AS k, p_size % 4 AS r, p_size * 3 % 70 AS c, p_size % 7 AS m, p_partkey % 4 = 1 AS py, p_partkey % 4 AS l FROM part),
n AS (SELECT *, 'src/m' || p || ['.rs', '.py', '.go', '.js'][l + 1] AS path, ['Rust', 'Python', 'Go', 'JavaScript'][l + 1] AS language,
  CASE WHEN py THEN 4 + 5 * r + c ELSE 3 + 7 * r + c END AS len, CASE WHEN py THEN 2 + 4 * r ELSE 1 + 4 * r END AS cyc, CASE WHEN py THEN 1 + 6 * r ELSE 6 * r END AS cog FROM q),
lines AS (SELECT *, CASE WHEN py THEN 1 ELSE 4 END + CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END AS comment, 1 + k AS blank, k * len + CASE WHEN k = 0 THEN 1 ELSE 0 END AS code FROM n),
fn AS (SELECT path, language, 'f' || j AS name, CASE WHEN py THEN 3 ELSE 6 END + (j - 1) * (len + 1) AS start_line, len AS n_lines, m AS n_params, cyc AS cyclomatic, cog AS cognitive FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM n WHERE k > 0)
  UNION ALL SELECT path, language, '<file>', 1, blank + comment + code, 0, 2, CASE WHEN py THEN 0 ELSE 1 END FROM lines WHERE k = 0)
"""
