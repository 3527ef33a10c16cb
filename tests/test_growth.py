"""Steps whose cost must not grow faster than their input."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from codeseam import storage
from codeseam.operators import duplicates, files as file_pass, history, metrics, smells
from codeseam.operators.rules import RULES, TOKENS
from codeseam.operators.structure import Facts, facts, file_functions
from codeseam.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_hunks_are_not_sent_to_the_driver(spark):
    # 1,000 lines a file, and hunks that begin and end within spans of lines
    files = spark.range(3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    lines = files.select("path", F.explode(F.expr("sequence(1L, 1000L)")).alias("line_no"), F.lit("Code").alias("kind"))
    hunks = spark.createDataFrame([("f0", 1, 63, "a", "a@x", 1), ("f0", 64, 66, "b", "b@x", 1), ("f0", 130, 5000, "A", "a@x", 2), ("f1", 900, 0, "b", "b@x", 3), ("f1", 1000, 1, "b", "b@x", 4)], "path string, start_line int, n_lines int, author string, email string, ts int")
    got = metrics.loc_by_author(lines, hunks)
    assert "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.select("email", "name", "files", "code").collect())) == [("a@x", "A", 1, 63 + 871), ("b@x", "b", 2, 67)]


def test_lines_without_smells_are_not_stored(spark):
    rows = [("a", "Python", 1, "x = 42", "Code"), ("a", "Python", 2, "run()", "Code"), ("a", "Python", 3, "# TODO", "Comment"), ("a", "Python", 4, "", "Blank"), ("a", "Python", 5, "# if(x) return y;", "Comment"), ("a", "Python", 6, "# if(x) return z;", "Comment")]
    lines = spark.createDataFrame(rows, "path string, language string, line_no long, text string, kind string")
    found = spark.createDataFrame([], "path string, language string, name string, start_line long, n_lines long, code_lines long, n_params long")
    few = smells.telling(lines)
    assert {r["line_no"] for r in few.collect()} == {1, 3, 5, 6}
    assert sorted(map(tuple, smells.smells(few, found).collect())) == sorted(map(tuple, smells.smells(lines, found).collect()))


def test_score_diff_measures_files_once(spark, monkeypatch):
    calls, real = [], file_pass.file_measures
    monkeypatch.setattr(file_pass, "file_measures", lambda *a, **k: calls.append(1) or real(*a, **k))
    queries.QUERIES["score_diff"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_score_diff_works_each_side_out_once(spark):
    got = queries.QUERIES["score_diff"](spark, "/root/testdata/sf0.001")
    # for the blocks and for the files that have some, on two sides
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4
    assert [tuple(r)[:2] for r in got.orderBy("position").collect()][-1] == (7, "overall")


def test_index_of_sources_reads_what_it_shows(spark, monkeypatch):
    asked, real = [], file_pass.file_measures
    monkeypatch.setattr(file_pass, "file_measures", lambda *a, **k: asked.append(k["parts"]) or real(*a, **k))
    queries.QUERIES["maintainability_sources"](spark, "/root/testdata/sf0.001")
    assert asked == [("tokens", "functions")]


def test_equal_lines_are_matched_once():
    rules = RULES["Go"]
    lines = ["func f(a int) {", *["    if a && b || c {", "    }"] * 500, "}"]
    facts(rules).clear()
    assert file_functions(lines, list(range(len(lines))), lines, rules) == [("f", 1, 1002, 1002, 1, 1501, 1500)]
    assert len(facts(rules)) == 4


def test_long_lines_are_matched_once(monkeypatch):
    calls, real = [], Facts.__missing__
    monkeypatch.setattr(Facts, "__missing__", lambda self, mask: calls.append(1) or real(self, mask))
    lines = [f"{'word ' * 100}and or {k} for" for k in range(5)] + [f"{'band ' * 100}{k}" for k in range(5)]
    assert file_functions(lines, list(range(10)), lines, RULES["Python"]) == [("<file>", 1, 10, 10, 0, 16, 4 + 8)]
    assert len(calls) == 10


def test_symbols_are_told_by_runs():
    # **= and = from one run, <= and - from another, ! is in no symbol alone
    assert file_pass.token_counts(["a **== b<=-1 !x", "def é if _y, _y"], TOKENS["Python"]) == (6, 5, 6, 6)


def test_more_rows_are_dealt_out_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    rows = spark.range(400).select((F.col("id") % 100).alias("commit_id"), F.col("id").cast("string").alias("path"))
    freq = rows.select("path", F.lit(3).alias("commits"))
    pairs = history.temporal_coupling(rows, freq)
    assert pairs.count() == 600 and pairs.rdd.getNumPartitions() == 12
    blame = rows.select("path", F.lit("a").alias("author"), (F.col("commit_id") % 5).cast("string").alias("email"), F.lit(1).alias("lines"), F.lit(0).alias("last_ts"))
    got = history.authors(blame, rows.select("path", F.lit("Go").alias("language")))
    assert got.rdd.getNumPartitions() == 8 and sorted((r["email"], r["lines"], r["owned_files"]) for r in got.collect()) == [(str(i), 80, 80) for i in range(5)]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    rows = spark.range(2000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.write.parquet(f"{tmp_path}/one")
    rows.repartition(8).write.parquet(f"{tmp_path}/many")
    rows.where("id < 0").write.parquet(f"{tmp_path}/none")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    per_task = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        one, many = spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/many")
        # more splits than cores, and all rows in one of them
        assert one.rdd.getNumPartitions() >= 4 and per_task(one) == [2000]
        got = queries.spread(one, "id")
        assert max(per_task(got)) < 600 and sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
        assert queries.spread(many, "id") is many
        assert queries.spread(spark.read.parquet(f"{tmp_path}/none"), "id").count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_score_diff_counts_windows_once(spark, monkeypatch):
    names, real = [], duplicates.stored
    monkeypatch.setattr(duplicates, "stored", lambda df, name: names.append(name) or real(df, name))
    queries.QUERIES["score_diff"](spark, "/root/testdata/sf0.001")
    assert names == ["windows"]


def test_sides_have_the_groups_they_have_alone(spark):
    # line n is in the files up to n, and in one of them twice
    files = {f"f{k}": [f"x{n}" for n in range(k, 6)] + ["x3"] * (k == 1) for k in range(6)}
    m = storage.stored(file_pass.file_measures(spark.createDataFrame([(p, "Python", "\n".join(x)) for p, x in files.items()], "path string, language string, content string"), window=1, parts=("windows",)), "measures")
    sides = {"path in ('f0', 'f2', 'f4')": {"f0", "f2", "f4"}, "path >= 'f4'": {"f4", "f5"}, "true": set(files), "nullif(path, path) = ''": set()}
    for most in (2, 4, 100):
        got = duplicates.side_groups(m, *map(F.expr, sides), most=most)
        for side, groups in zip(sides.values(), got, strict=True):
            places = [[(p, at) for p in sorted(side) for at, x in enumerate(files[p]) if x == f"x{n}"] for n in range(6)]
            assert sorted([tuple(x) for x in r["locs"]] for r in groups.collect()) == sorted(x for x in places if 2 <= len(x) <= most)


def share(files, size):
    """(duplicated lines, groups, lines) of files (path: lines): windows of the same shape (files and
    distances) whose first offsets follow each other are one block."""
    places, firsts = defaultdict(list), defaultdict(set)
    for p, x in sorted(files.items()):
        for at in range(len(x) - size + 1):
            places[tuple(x[at : at + size])].append((p, at))
    for locs in places.values():
        if len(locs) >= 2:
            firsts[tuple((p, at - locs[0][1]) for p, at in locs)].add(locs[0][1])
    begins = {shape: sum(at - 1 not in own for at in own) for shape, own in firsts.items()}
    return sum((len(shape) - 1) * (len(own) + (size - 1) * begins[shape]) for shape, own in firsts.items()), sum(begins.values()), sum(map(len, files.values()))


def test_shares_are_of_all_blocks_however_often_they_occur(spark):
    rng = random.Random(4)
    # runs of one line, few lines in any order, a block of many files with and without more lines, short and empty files
    files = {f"r{k:03}": [rng.choice("aab") + " = 1" for _ in range(rng.randrange(30))] for k in range(40)}
    files |= {f"s{k:03}": ["x()"] * (k % 3) + [f"step{n}()" for n in range(7)] + [f"only{k % 50}()"] * (k % 5 == 0) for k in range(150)}
    files |= {f"t{k:03}": [f"w{n}()" for n in range(k, 30)] for k in range(25)}
    rows = [(p, "Python", "\n".join(x)) for p, x in files.items()]
    sides = {"path < 's100'": lambda p: p < "s100", "path like '%5' or path > 't'": lambda p: p.endswith("5") or p > "t", "true": lambda p: True, "path < 'a'": lambda p: False}
    for size in (1, 3):
        m = storage.stored(file_pass.file_measures(spark.createDataFrame(rows, "path string, language string, content string"), window=size, parts=("windows",)), "measures")
        got = duplicates.side_shares(m, *map(F.expr, sides), size=size)
        for keep, found in zip(sides.values(), got, strict=True):
            want = share({p: x for p, x in files.items() if keep(p)}, size)
            assert tuple(found.select("duplicated_lines", "duplicate_groups", "total_code_lines").first()) == want
        assert "collect_list" not in plan(got[0]) and want == (0, 0, 0)


def test_score_diff_counts_windows_of_many_files(spark, tmp_path):
    spark.range(140).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a = 1\nb = 2\nc = 3").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["name"]: r for r in queries.QUERIES["score_diff"](spark, str(tmp_path)).collect()}
    # all lines but those of one file are duplicates: 119 of 120 before, 139 of 140 after; with the cap there were none
    assert (got["duplication"]["before_score"], got["duplication"]["after_score"]) == (round(100 / 120 / 6, 4), round(100 / 140 / 6, 4))
