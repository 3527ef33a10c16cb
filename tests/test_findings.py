import json
import os

import pytest
from pyspark.sql import functions as F

from codeseam import cli, report
from codeseam.sources.findings import FindingsWriter, Written, write_findings


def made(spark, n, parts=7):
    return spark.range(0, n, 1, parts).select(F.format_string("src/%07d.py", "id").alias("path"), (F.col("id") % 90 + 1).alias("line"), F.lit("Title").alias("title"), F.format_string('say "%d" | é', "id").alias("message"), F.lit("minor").alias("severity"))


def parts(folder):
    return [(folder / x).read_text(encoding="utf-8") for x in sorted(os.listdir(folder)) if x.startswith("part-")]


def test_a_million_findings(spark, tmp_path):
    """All rows, each once and in order, and no folder of an attempt left."""
    folder = tmp_path / "out"
    assert write_findings(made(spark, 1_000_000), str(folder), "annotations") == 1_000_000
    found = [line for text in parts(folder) for line in text.splitlines()]
    assert len(found) == len(set(found)) == 1_000_000 and found == sorted(found)
    assert found[5] == '::warning file=src/0000005.py,line=6,title=Title::say "5" | é'
    assert all(x.startswith("part-") or x == "_SUCCESS" for x in os.listdir(folder))


def test_kinds_and_modes(spark, tmp_path):
    folder = tmp_path / "out"
    rows = [r.asDict() for r in made(spark, 50).collect()]
    assert write_findings(made(spark, 50), str(folder), "quality") == 50
    assert [e for text in parts(folder) for e in json.loads(text)] == json.loads(report.quality_entries(rows))
    assert write_findings(made(spark, 50), str(folder), "lines") == 50  # in place of the others
    assert [json.loads(line) for text in parts(folder) for line in text.splitlines()] == rows
    assert write_findings(made(spark, 3), str(folder), "lines", "append") == 3 and sum(len(t.splitlines()) for t in parts(folder)) == 53
    assert write_findings(made(spark, 0), str(folder), "quality") == 0 and parts(folder) == []
    with pytest.raises(Exception, match="kind is one of"):
        write_findings(made(spark, 1), str(folder), "none")


def test_failures_leave_the_folder_as_it_was(spark, tmp_path):
    folder = tmp_path / "out"
    write_findings(made(spark, 5), str(folder), "lines")
    before = sorted(os.listdir(folder)), parts(folder)
    failing = made(spark, 100).withColumn("line", F.when(F.col("line") < 80, F.col("line")).otherwise(F.raise_error(F.lit("no line"))))
    with pytest.raises(Exception, match="no line"):
        write_findings(failing, str(folder), "lines")
    assert (sorted(os.listdir(folder)), parts(folder)) == before
    # an attempt that Spark did not accept is not moved
    writer = FindingsWriter({"path": str(folder), "kind": "lines"}, True)
    os.makedirs(writer.aside)
    for attempt in ("1-part-00000-x.jsonl", "2-part-00000-x.jsonl"):
        (tmp_path / "out" / os.path.basename(writer.aside) / attempt).write_text(attempt)
    writer.commit([Written("2-part-00000-x.jsonl", 1), None])
    assert parts(folder) == ["2-part-00000-x.jsonl"] and len(os.listdir(folder)) == 2


def test_commands_write_findings(spark, tmp_path, capsys):
    """Files by tasks hold what the command prints without them."""
    (tmp_path / "a.py").write_text("def f(a, b, c, d, e):\n    # TODO later\n    if a and b:\n        return 42\n")
    (tmp_path / "b.py").write_text("def g(a):\n    if a:\n        return 1\n    # FIXME\n")

    def out(*args):
        assert cli.main([args[0], str(tmp_path), *args[1:]], spark) == 0
        return capsys.readouterr().out.rstrip("\n")

    for command in (("smells",), ("cycom", "--min-complexity", "1")):
        folder = tmp_path / f"found-{command[0]}"
        printed = out(*command, "--format", "github")
        assert out(*command, "--format", "github", "--into", str(folder)).startswith(f"{len(printed.splitlines())} finding(s) in ")
        assert "".join(parts(folder)).rstrip("\n") == printed and len(printed.splitlines()) > 1
        entries = json.loads(out(*command, "--format", "gitlab"))
        out(*command, "--format", "gitlab", "--into", str(folder))
        assert [e for text in parts(folder) for e in json.loads(text)] == entries
    for complexity, level in ((9, "info"), (10, "minor"), (15, "major"), (25, "critical")):
        one = spark.createDataFrame([("p", "f", 1, complexity)], "path string, name string, start_line long, cyclomatic int")
        assert report.complexity_findings(one, "cyclomatic", 1).first()["severity"] == level
