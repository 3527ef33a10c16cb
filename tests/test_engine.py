import pytest
from pyspark.sql import functions as F

from codeseam.functions.languages import BY_NAME, by_shebang
from codeseam.functions.lines import kinds, lines_of
from codeseam.operators import history, metrics


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("Java", "\t\n", (2, 0, 0)),
        ("Java", "total += price; // net", (0, 0, 1)),
        ("Java", 'log("/* kept */ // kept");', (0, 0, 1)),
        ("Java", "/* licence\n\nend */ run();", (0, 2, 1)),
        ("Java", "/* one /* two */ go();", (0, 0, 1)),
        ("Swift", "/* one\n/* two */\nthree */\ngo()", (0, 3, 1)),
        ("Rust", "impl<'t> Node<'t> {", (0, 0, 1)),
        ("Python", "q = '''\n# text\n'''\n# note", (0, 1, 3)),
        ("Perl", "#!/usr/bin/perl\n# note\nprint 2;", (0, 1, 2)),
        ("Haskell", "{-# OPTIONS -Wall #-}\nf = g\n{- a {- b -} c -}", (0, 1, 2)),
        ("Haskell", "a --| b\n--| c\n-- d", (0, 1, 2)),
        ("Go", 's := "never closed\nt := 2', (0, 0, 2)),
    ],
)
def test_kinds(language, text, expected):
    got = kinds(text.split("\n"), BY_NAME[language])
    assert tuple(got.count(k) for k in ("Blank", "Comment", "Code")) == expected


def test_shebang():
    assert by_shebang("#!/usr/bin/env -S python3") == "Python"
    assert by_shebang("#!/bin/sh") == "Bourne Shell"
    assert by_shebang("no") is None


def test_lines_and_indexes(spark):
    files = spark.createDataFrame([("a.toml", "TOML", "# c\nx = 1\n\n"), ("b.c", "C", "/*\n*/\nint x;\n"), ("c.c", "C", "a\0b")], "path string, language string, content string")
    got = {(r["path"], r["kind"]): r["n"] for r in lines_of(files).groupBy("path", "kind").agg(F.count("*").alias("n")).collect()}
    assert got == {("a.toml", "Comment"): 1, ("a.toml", "Code"): 1, ("a.toml", "Blank"): 1, ("b.c", "Comment"): 2, ("b.c", "Code"): 1}
    row = spark.range(1).select(metrics.mi_visual_studio(F.lit(100.0), F.lit(5), F.lit(50)).alias("a"), metrics.mi_visual_studio(F.lit(50000.0), F.lit(100), F.lit(2000)).alias("b")).first()
    assert row["a"] == pytest.approx(48.26, abs=0.01)
    assert row["b"] == 0


def test_coupling_and_age(spark):
    changes = spark.createDataFrame([(c, p) for c in range(3) for p in ("a", "b")], "commit_id long, path string")
    freq = spark.createDataFrame([("a", 5), ("b", 3)], "path string, commits long")
    assert history.temporal_coupling(changes, freq).first()["strength"] == 1.0
    with pytest.raises(ValueError, match="fewer"):
        history.age(freq, F.current_timestamp(), 400, 365)
