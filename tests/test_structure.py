import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeseam.functions.paths import Exclusions, is_generated, is_test_file, is_test_path
from codeseam.operators import duplicates, files, history, metrics, score, smells
from codeseam.operators.rules import RULES, TOKENS
from codeseam.operators.structure import masked

FILES = "path string, language string, content string"


def functions_of(content, language):
    row = files.measured("f", language, content, 3, False, False)
    return [tuple(f.values()) for f in row.get("functions") or []]


@pytest.mark.parametrize(
    ("language", "body", "cyclomatic", "cognitive"),
    [
        ("Go", "if ready {\nfor n := range list {\nif n > 3 {\n}\n}\n}", 4, 6),
        ("Go", "switch mode {\ncase a:\ncase b:\n}", 4, 1),
        ("Go", "if p && q && r {\n} else if s || t {\n} else {\n}", 6, 5),
        ("Kotlin", "when (x) {\n}\nwhile (open) { step() }", 3, 2),
        ("Swift", "guard ready else {\n}\nrepeatable(forward, iffy)", 2, 1),
        ("Zig", "if (a) {\n} else if (b) {\n}", 4, 3),
        ("Kaikai", "match m and n or o {\n}", 4, 3),
    ],
)
def test_complexity_with_braces(language, body, cyclomatic, cognitive):
    start = RULES[language].starts[0]
    (only,) = functions_of(f"{start}work() {{\n{body}\n}}\n", language)
    assert (only[0], *only[-2:]) == ("work", cyclomatic, cognitive)


@pytest.mark.parametrize(
    ("language", "text", "cyclomatic", "cognitive"),
    [
        ("Python", "def work():\n    while run:\n        try:\n            go()\n        except E:\n            no()\n", 3, 3),
        ("Ruby", "def work\n    unless a || b\n        c\n    end\nend\n", 3, 2),
        ("Elixir", "defp work do\n    cond do\n        x -> if y\n    end\nend\n", 3, 3),
        ("Lua", "function work()\n    if a then\n    elseif b then\n    end\nend\n", 3, 2),
        ("Julia", "function work()\n    for i in v\n        i && j\n    end\nend\n", 3, 2),
        ("Nim", "proc work() =\n    case x\n", 2, 1),
        ("OCaml", "let work x =\n    match x with\n", 3, 1),
        ("Clojure", "(defn work [x]\n    (when x y))\n", 2, 1),
    ],
)
def test_complexity_by_indentation(language, text, cyclomatic, cognitive):
    first = functions_of(text, language)[0]
    assert first[-2:] == (cyclomatic, cognitive)


def test_functions_and_files_without():
    java = "class A {\n  int twice(int a, Map<K, V> b) {\n    return 2 * a;\n  }\n  void open(\n    int c\n  )\n  {\n    if (c) {\n    }\n  }\n}\n"
    # a declaration over several lines does not end as one is told by
    assert [(f[0], f[1], f[4]) for f in functions_of(java, "Java")] == [("twice", 2, 3)]
    assert functions_of("#define TWICE(a) (2 * (a))\nint x;\n", "C")[0][0] == "<file>"
    assert functions_of("main = if a then b else c\n", "Haskell") == [("<file>", 1, 1, 1, 0, 2, 0)]
    assert functions_of("fn open(a: i32,\n", "Rust")[0][4] == 0  # never closed
    assert functions_of("-- note\n", "Lua") == []


@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("end", ["", "q"])
def test_masks_of_very_long_lines(spark, quote, end):
    inside = "a\\b" * 350_000
    line = f"x = {quote}{inside}{quote if end else ''}"
    assert masked(line, RULES["C"]).startswith(f"x = {quote} ")
    df = spark.createDataFrame([(line,)], "text string").repartition(2)
    got = df.select(metrics.masked(F.col("text"), ("//",)).alias("m")).first()["m"]
    assert got == f"x = {quote}{quote}"


def test_masked():
    assert masked("y = 7; // it isn't", RULES["Go"]) == "y = 7; "
    assert masked('open("ftp://h"); while z', RULES["Go"]) == 'open("       "); while z'
    assert masked("s = 'it # s' # c", RULES["Ruby"]) == "s = '      ' "
    assert masked('say("go', RULES["OCaml"]) == 'say("  '


def test_tokens():
    assert files.token_counts(["a += b ** 2;", "return a"], TOKENS["Python"]) == (4, 3, 4, 4)
    assert files.token_counts(["x <<= y >>> 1"], TOKENS["JavaScript"])[0] == 2
    assert files.token_counts(["let mut"], TOKENS["Rust"]) is None
    assert files.string_interiors(['a = """x', "inside", 'end"""', "b = 'c\"\"\"'", "d"]) == {1}


def test_measures_of_files(spark):
    rows = [("a.py", "Python", "def f():\n    if a:\n        b\n"), ("b", "Python", ""), ("c", "Python", None), ("d", None, "x"), ("e.rs", "Rust", "a\0b"), ("f", "TOML", "x = 1"), ("g.rs", "Rust", "fn a() {\n}\n#[cfg(test)]\nfn t() {\n}\n")]
    got = {r["path"]: r for r in files.file_measures(spark.createDataFrame(rows, FILES), 2, strip_tests=True).collect()}
    assert set(got) == {"a.py", "b", "f", "g.rs"}
    assert (got["a.py"]["code"], got["a.py"]["functions"][0]["cognitive"], got["a.py"]["total_indent"]) == (3, 1, 3)
    assert got["b"]["code"] == 0 and got["b"]["functions"] is None and got["f"]["functions"] is None
    assert (got["g.rs"]["code"], got["g.rs"]["n_normalized"], len(got["g.rs"]["window_h"])) == (5, 2, 1)
    assert files.file_measures(spark.createDataFrame([], FILES)).count() == 0
    raw = spark.createDataFrame([("a.go", "Go", b"x\n\xff\ny\r\n"), ("b.go", "Go", b"z")], "path string, language string, content binary")
    assert {r["path"]: (r["code"], bool(r["error"])) for r in files.file_measures(raw).collect()} == {"a.go": (None, True), "b.go": (1, False)}
    assert {r["path"]: r["code"] for r in files.file_measures(raw, lenient=True).collect()} == {"a.go": 2, "b.go": 1}


def test_duplicates_and_score(spark):
    block = "".join(f"step{i}(now);\n" for i in range(8))
    rows = [("a.go", "Go", "one();\n" + block), ("b.go", "Go", block + "two();\n"), ("c.md", "Markdown", block)]
    m = files.file_measures(spark.createDataFrame(rows, FILES), 6)
    found = duplicates.blocks(duplicates.window_groups(m.where("path <> 'c.md'")), 6)
    (one,) = duplicates.located(found, m).collect()
    assert [tuple(x) for x in one["locations"]] == [("a.go", 2, 9), ("b.go", 1, 8)] and one["duplicated_lines"] == 8
    scores = score.file_scores(m)
    assert {r["path"] for r in scores.collect()} == {"a.go", "b.go"}  # a text file is no code
    dims = score.dimensions(scores, duplicates.summary(found, m))
    assert [r["name"] for r in dims.orderBy("position").collect()] == list(score.MODELS["cogcom"].weights)
    empty = score.file_scores(m.limit(0))
    none = score.project(score.dimensions(empty, duplicates.summary(found, m)), empty).first()
    assert (none["score"], none["grade"], none["files_analyzed"]) == (0.0, "F--", 0)
    same = {r["name"]: r["delta"] for r in score.difference(dims, dims).collect()}
    assert same["overall"] == 0.0 and len(same) == 6
    with pytest.raises(Exception, match="different models"):
        score.difference(dims, score.dimensions(score.file_scores(m, "legacy"), duplicates.summary(found, m), "legacy")).collect()


def test_gates():
    score.check_score(80.004, 80.001, "B", fail_if_worse=True)
    with pytest.raises(score.GateError, match="dropped 80.01"):
        score.check_score(80.01, 80.0, "B", fail_if_worse=True)
    with pytest.raises(score.GateError, match="minimum threshold A-"):
        score.check_score(0, 0, "B+", fail_below="a-")
    score.check_score(0, 0, "A", fail_below="A-")
    score.check_duplication(3, 5.0, 3, 5.0, 5.0)
    for bad in ({"max_groups": 2}, {"max_ratio": 4.9}, {"before": 4.98}):
        with pytest.raises(score.GateError):
            score.check_duplication(3, 5.0, **bad)


def components_by_hand(edges):
    after = {}
    for x, y in edges:
        after.setdefault(x, set()).add(y)

    def reached(x):
        seen, stack = set(), list(after.get(x, ()))
        while stack:
            y = stack.pop()
            if y not in seen:
                seen.add(y)
                stack += after.get(y, ())
        return seen

    far = {x: reached(x) for e in edges for x in e}
    # a file that names itself is no cycle
    return {x: min(y for y in far[x] if x in far[y]) for x in far if any(x in far[y] for y in far[x] if y != x)}


def test_cycles(spark):
    cycles = lambda edges: dict(map(tuple, history.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert cycles([]) == {}
    rng = random.Random(4)
    graphs = [[(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (20, 21), (21, 22), (9, 9), (5, 20)]]
    for n, m in ((12, 14), (25, 40)):
        graphs.append([(rng.randrange(n), rng.randrange(n)) for _ in range(m)])
    # two files with several ways on, joined by chains; one chain leads away from both
    graphs.append([(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 5), (5, 6), (6, 3), (3, 7), (7, 8), (8, 9), (3, 10), (11, 4), (10, 0)])
    for edges in graphs:
        assert cycles(edges) == components_by_hand(edges)


def test_cycles_of_long_rings_and_chains(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(history, "stored", lambda df, name, f=history.stored: rounds.append(name) or f(df, name))
    ring = spark.range(10_000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    chain = spark.range(20_000, 30_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = history.cycles(ring.unionByName(chain)).agg(F.count("*"), F.min("cycle"), F.max("cycle"), F.max("file")).first()
    assert tuple(got) == (10_000, 0, 0, 9_999) and rounds.count("reach") < 20


def test_coupling_of_commits_of_any_size(spark):
    rng = random.Random(5)
    commits = {c: rng.sample(range(60), n) for c, n in enumerate((1, 2, 7, 30, 60))}
    rows = spark.createDataFrame([(c, f"f{p}") for c, ps in commits.items() for p in ps], "commit_id long, path string")
    expected = Counter(tuple(sorted((f"f{x}", f"f{y}"))) for ps in commits.values() for i, x in enumerate(ps) for y in ps[:i])
    freq = rows.groupBy("path").agg(F.count("*").alias("commits"))
    for block in (1, 4, 1000):
        got = history.temporal_coupling(rows, freq, min_degree=1, block=block).collect()
        assert {(r["file_a"], r["file_b"]): r["shared_commits"] for r in got} == expected
    # cells of a commit of 20,000 files are tasks of their own
    large = spark.range(20_000).select(F.lit(1).alias("commit_id"), F.col("id").alias("file"))
    cells = history.paired(large, 5_000).select("x", "y")
    assert cells.count() == 20_000 * 19_999 // 2


def test_windows_are_all_windows(spark):
    rng = random.Random(6)
    texts = {f"p{i}": "\n".join(rng.choice(["a = 1", "b = 2", "  c()", "", "# note"]) for _ in range(rng.randrange(25))) for i in range(20)}
    m = files.file_measures(spark.createDataFrame([(p, "Python", t) for p, t in texts.items()], FILES), 3, parts=("windows",)).cache()
    assert set(m.columns) == {c for c, _ in files.BASE} | {c for c, _ in files.PARTS["windows"]}
    places = defaultdict(list)
    for p, t in texts.items():
        own = [x.strip() for x in t.split("\n") if x.strip() and not x.startswith("#")]
        for i in range(len(own) - 2):
            places[tuple(own[i : i + 3])].append((p, i))
    got = [sorted(map(tuple, r["locs"])) for r in duplicates.window_groups(m, 9).collect()]
    assert sorted(got) == sorted(sorted(x) for x in places.values() if 2 <= len(x) <= 9)
    assert duplicates.windows(m).select("h", "g").distinct().count() == len(places)


def test_smells(spark):
    code = ["wait(250);", "a = 0x1F;", "b = 2.5e3;", "c = 12_000;", "d = 0 + 1 - 1 + 2;", "static n = 88;", "final m = 9;", "e = y-1;", "f = v64;", "h = -5;"]
    notes = ["// p = q;", "// while(r) {", "// return s;", "// } {;", "// some words"]
    rows = [("a", "C", i, t, "Code") for i, t in enumerate(code, 1)] + [("a", "C", 20 + i, t, "Comment") for i, t in enumerate(notes)] + [("b", "C", 1, "// p = q;", "Comment"), ("b", "C", 2, "// a hack", "Comment")]
    lines = spark.createDataFrame(rows, "path string, language string, line_no long, text string, kind string")
    assert sorted(r["line_no"] for r in smells.magic_numbers(lines).collect()) == [1, 2, 3, 4, 10]
    assert [tuple(r) for r in smells.commented_out_code(lines).collect()] == [("a", 20, 4)]
    found = spark.createDataFrame([("a", "C", "f", 1, 55, 55, 5), ("a", "C", "g", 60, 52, 52, 4)], "path string, language string, name string, start_line long, n_lines long, code_lines long, n_params long")
    got = {r["path"]: r.asDict() for r in smells.smell_counts(smells.smells(lines, found)).collect()}
    assert got["a"] == {"path": "a", "magic_number": 5, "long_function": 1, "long_parameters": 1, "debt": 0, "commented_out_code": 1, "total": 8}
    assert got["b"]["debt"] == 1


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a_test.rs", "a.test.ts", "FooTest.java", "test_a.py", "a_test.txt", "tests/a.rs", "src/testing/a.rs", "x/go.sum", "x/a.min.js", "Makefile")], "path string")
    p = F.col("path")
    got = {r["path"]: tuple(r)[1:] for r in df.select("path", is_test_file(p), is_test_path(p), is_generated(p)).collect()}
    assert [k for k, v in got.items() if v[0]] == ["src/a_test.rs", "a.test.ts", "FooTest.java", "test_a.py"]
    assert [k for k, v in got.items() if v[1] and not v[0]] == ["tests/a.rs"]
    assert [k for k, v in got.items() if v[2]] == ["x/go.sum", "x/a.min.js"]
    kept = Exclusions(only=(".RS",), folders=("testing",), globs=("src/*_test.*",))
    assert {r["path"]: r[1] for r in df.select("path", kept.reasons(p)).collect()} | {} == {k: ", ".join(x) for k, x in {"src/a_test.rs": ["glob"], "a.test.ts": ["extension"], "FooTest.java": ["extension"], "test_a.py": ["extension"], "a_test.txt": ["extension"], "tests/a.rs": [], "src/testing/a.rs": ["directory"], "x/go.sum": ["extension"], "x/a.min.js": ["extension"], "Makefile": ["extension"]}.items()}
