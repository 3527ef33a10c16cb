import json
import os
import subprocess
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains, StringStartsWith

from codeseam import cli, config
from codeseam.functions.paths import Exclusions
from codeseam.operators import dependencies
from codeseam.sources import history as git_history
from codeseam.sources.history import HistoryReader, history_table, kept_hunks, repository, touched, unquoted
from codeseam.sources.tree import Ignore, Rules, Scan, source_files


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())


def git(root, *args, who="Ann", when="2024-01-01T00:00:00Z"):
    env = os.environ | {"GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": f"{who.lower()}@example.org", "GIT_COMMITTER_NAME": who, "GIT_COMMITTER_EMAIL": f"{who.lower()}@example.org", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    subprocess.run(["git", "-C", str(root), "-c", "init.defaultBranch=main", *args], check=True, capture_output=True, env=env)


@pytest.mark.parametrize(
    ("line", "path", "folder", "fits"),
    [("*.log", "a/b.log", False, True), ("/top", "top", True, True), ("/top", "a/top", True, False), ("out/", "a/out", True, True), ("out/", "out", False, False), ("a/**/z", "a/b/c/z", False, True), ("doc/*.txt", "doc/x/y.txt", False, False), ("v[0-9]", "v7", False, True), ("**/tmp", "p/q/tmp", True, True), ("gen/**", "gen/a/b", False, True)],
)
def test_ignore_lines(line, path, folder, fits):
    assert Ignore.parse("", line).fits(path, folder) == fits


def test_tree(spark, tmp_path):
    write(tmp_path, {".gitignore": "*.gen.go\n!keep.gen.go\nbuild/\n", "a.go": "x", "b.gen.go": "x", "keep.gen.go": "x", "build/c.go": "x", ".hidden/d.py": "x", "run": "#!/bin/sh\n", "plain": "x", "tests/e.py": "x", "f_test.go": "x", "sub/.gitignore": "/g.py\n", "sub/g.py": "x", "sub/deep/g.py": "x", ".git/h.py": "x", "bin.c": b"\0\1", "vendor/v.c": "x"})
    os.symlink(tmp_path / "a.go", tmp_path / "link.go")
    got = lambda **more: {r["path"]: r["language"] for r in source_files(spark, Scan(str(tmp_path), **more)).collect()}
    assert got() == {"a.go": "Go", "keep.gen.go": "Go", ".hidden/d.py": "Python", "run": "Bourne Shell", "sub/deep/g.py": "Python", "bin.c": "C", "vendor/v.c": "C"}
    assert {"tests/e.py", "f_test.go"} <= set(got(include_tests=True))
    assert set(got(exclusions=Exclusions(only=("py",), folders=("vendor",)))) == {".hidden/d.py", "sub/deep/g.py"}
    with pytest.warns(UserWarning, match="invalid glob"):
        Scan(str(tmp_path), exclusions=Exclusions(globs=("[a", "*.go"))).skips_file("a.go")
    assert got(only_paths=("a.go", "run", "none.py")) == {"a.go": "Go"}
    (tmp_path / "empty").mkdir()
    assert source_files(spark, Scan(str(tmp_path / "empty"))).count() == 0


def kept(root):
    return set(Scan(str(root), include_tests=True).listed(Rules.at(str(root)))[0])


def test_ignored_as_by_git(spark, tmp_path, monkeypatch):
    """The files that git would add, for lines above, in and below the scanned folder."""
    home = tmp_path / "home"
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(home / ".config"))
    write(home, {".config/git/ignore": "*.user\n"})
    root = tmp_path / "top"
    root.mkdir()
    git(root, "init")
    names = ["a.c", "a.log", "keep.log", "a.user", "b.local", "b.user", "build/a.c", "sub/build/a.c", "doc/a.txt", "doc/x/a.txt", "x y.c", "tail ", "#hash", "!bang", "deep/er/est/z.c", "deep/z.c", "v1.c", "v2.c", "sub/a.log", "sub/gen/a.c", "sub/gen/keep.c", "sub/only/a.c", "sub/keep.log", "sub/b.local", "é/ü.c", "é/ö.c", "a/**b", "sub/deep/a.log", "sub/deep/g.c", "g.c"]
    write(root, dict.fromkeys(names, "x"))
    write(root, {".gitignore": "*.log\n!keep.log\n/build/\ndoc/*.txt\n\\#hash\n\\!bang\ntail\\ \ndeep/**/z.c\nv[!1].c\n# no rule\n\nx\\ y.c   \n\u00fc.c\n!b.user\n", "sub/.gitignore": "!a.log\ngen/*\n!gen/keep.c\n/g.c\nonly/\n", "sub/deep/.gitignore": "*\n!g.c\n", ".git/info/exclude": "*.local\n"})
    everything = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files if ".git" not in os.path.relpath(d, root).split("/"))
    said = subprocess.run(["git", "-C", str(root), "check-ignore", "-z", "--stdin"], input="\0".join(everything).encode(), capture_output=True).stdout.decode().split("\0")
    expected = set(everything) - set(said)
    assert {"a.log", "a.user", "b.local", "sub/b.local", "deep/z.c", "v2.c"} <= set(said) and {"b.user", "sub/a.log", "sub/gen/keep.c", "g.c"} <= expected
    assert kept(root) == expected
    assert kept(root / "sub") == {x[4:] for x in expected if x.startswith("sub/")}
    assert kept(root / "sub" / "deep") == {x[9:] for x in expected if x.startswith("sub/deep/")}
    by_tasks = {r["path"] for r in source_files(spark, Scan(str(root), include_tests=True), most=3).collect()}
    assert by_tasks == {r["path"] for r in source_files(spark, Scan(str(root), include_tests=True)).collect()} == {x for x in expected if x.endswith((".c", ".txt"))}
    assert {r["path"] for r in source_files(spark, Scan(str(root), include_tests=True), most=0).collect()} == by_tasks


def test_ignore_files_and_repositories(tmp_path):
    """.ignore files hold everywhere and come first; .gitignore files in a repository only, and not
    beyond the root of a repository inside another."""
    write(tmp_path, {".gitignore": "*.log\n", ".ignore": "!kept.log\n*.tmp\n", "a.log": "", "kept.log": "", "a.tmp": "", "in/.git/info/exclude": "e.c\n", "in/e.c": "", "in/a.log": "", "in/.gitignore": "b.log\n", "in/b.log": "", "in/a.tmp": ""})
    dots = {".gitignore", ".ignore", "in/.gitignore"}
    assert kept(tmp_path) == dots | {"a.log", "kept.log", "in/a.log"}
    (tmp_path / ".git").mkdir()
    assert kept(tmp_path) == dots | {"kept.log", "in/a.log"}
    assert kept(tmp_path / "in") == {".gitignore", "a.log"}


def test_folders_that_cannot_be_read(spark, tmp_path):
    write(tmp_path, {"a/b.c": "x", "c.c": "x"})
    scan = Scan(str(tmp_path))
    assert list(scan.entries("gone/", Rules())) == [("gone/", "error", "No such file or directory")]
    with pytest.warns(UserWarning, match="none: No such file"):
        assert source_files(spark, Scan(str(tmp_path / "none"))).count() == 0


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init")
    write(root, {"src/a.py": "def f(a):\n    if a:\n        return 1\n", "src/b.py": "from . import a\n"})
    git(root, "add", "-A")
    git(root, "commit", "-m", "one")
    write(root, {"src/a.py": "def f(a):\n    if a and b:\n        return 1\n    return 2\n", "src/é x.py": "y = 1\n"})
    git(root, "add", "-A")
    git(root, "commit", "-m", "two", who="Bob", when="2024-03-01T00:00:00Z")
    git(root, "mv", "src/b.py", "src/c.py")
    git(root, "commit", "-m", "three", when="2024-05-01T00:00:00Z")
    return root


def test_history(spark, repo):
    root = str(repo)
    commits = history_table(spark, root, "commits").orderBy("ts").collect()
    assert [(r["author"], r["n_parents"]) for r in commits] == [("Ann", 0), ("Bob", 1), ("Ann", 1)]
    files = history_table(spark, root, "commit_files").join(history_table(spark, root, "commits"), "commit_id")
    assert sorted((r["ts"].month, r["path"]) for r in files.collect()) == [(1, "src/a.py"), (1, "src/b.py"), (3, "src/a.py"), (3, "src/é x.py"), (5, "src/b.py"), (5, "src/c.py")]
    hunks = {(r["path"], r["start_line"]): (r["n_lines"], r["email"]) for r in history_table(spark, root, "hunks").collect()}
    assert hunks[("src/a.py", 2)] == (1, "bob@example.org") and hunks[("src/a.py", 4)] == (1, "bob@example.org") and hunks[("src/c.py", 1)] == (1, "ann@example.org")
    old = {r["path"]: bytes(r["content"]) for r in history_table(spark, root, "files", "HEAD~2").collect()}
    assert set(old) == {"src/a.py", "src/b.py"} and old["src/b.py"] == b"from . import a\n"
    assert repository(str(repo / "src"))[1] == "src/"
    assert unquoted('"a\\303\\251\\"b"') == 'aé"b'
    with pytest.raises(ValueError):
        history_table(spark, "/", "commits")


def asked(root, table, *filters, **options):
    """The items that tasks would get under filters, and the filters that are left to Spark."""
    reader = HistoryReader({"path": str(root), "table": table} | options)
    left = list(reader.pushFilters(list(filters)))
    return [x for p in reader.partitions() for x in p.items], left


def test_filters_reach_the_repository(spark, repo):
    """Commits outside a span and files outside a folder are not asked for."""
    day = lambda m: datetime(2024, m, 1, tzinfo=timezone.utc)
    ids = [r["commit_id"] for r in history_table(spark, str(repo), "commits").orderBy("ts").collect()]
    write(repo, {"lib/d.py": "d = 1\n", "srcs.py": "s = 1\n"})
    git(repo, "add", "-A")
    git(repo, "commit", "-m", "four", when="2024-06-01T00:00:00Z")
    since, other = GreaterThanOrEqual(("ts",), day(3)), EqualTo(("author",), "Ann")
    found, left = asked(repo, "commits", IsNotNull(("ts",)), since, other)
    assert len(found) == 3 and ids[0] not in found and left == [other]
    assert asked(repo, "commits", since, LessThan(("ts",), day(5))) == ([ids[1]], [])
    assert asked(repo, "commits", GreaterThanOrEqual(("ts",), day(7)))[0] == []
    assert len(asked(repo, "commit_files", GreaterThanOrEqual(("committed",), day(5)), StringStartsWith(("path",), "src/"))[0]) == 2
    names = lambda *filters, **options: sorted(path for _, path in asked(repo, "hunks", *filters, **options)[0])
    assert names(StringStartsWith(("path",), "src/a")) == ["src/a.py"] and names(In(("path",), ("lib/d.py", "none"))) == ["lib/d.py"]
    assert asked(repo, "hunks", StringContains(("path",), "a"))[1] == [StringContains(("path",), "a")]
    assert names(since_ref="HEAD~1") == ["lib/d.py", "srcs.py"]

    for table, condition in [("commits", F.col("ts") >= F.timestamp_seconds(F.lit(int(day(3).timestamp())))), ("commits", "ts < '2024-03-01' and author = 'Ann'"), ("commit_files", "committed >= '2024-03-01' and path like 'src/%'"), ("commit_files", "path = 'srcs.py'"), ("hunks", "path in ('src/a.py', 'lib/d.py') and n_lines > 0"), ("files", "path like 'src%'")]:
        whole = history_table(spark, str(repo), table)
        rows = lambda df: sorted(map(str, df.collect()))
        kept = whole.where(condition)
        assert rows(kept) == rows(spark.createDataFrame(whole.collect(), whole.schema).where(condition)) and kept.count(), (table, condition)
    plan = history_table(spark, str(repo), "commits").where(F.col("ts") >= F.timestamp_seconds(F.lit(int(day(3).timestamp()))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.splitlines()[0]


def test_commands_over_a_span_of_time(spark, repo, capsys):
    """With --since, files that change together are counted in commits of that span only."""
    def tc(*args):
        assert cli.main(["tc", str(repo), "--min-degree", "1", "--min-strength", "0", "--format", "json", *args], spark) == 0
        return {(r["file_a"], r["file_b"]): r["shared_commits"] for r in json.loads(capsys.readouterr().out)}

    write(repo, {"src/a.py": "a = 2\n", "src/c.py": "c = 2\n"})
    git(repo, "add", "-A")
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    git(repo, "commit", "-m", "now", when=now)
    assert ("src/a.py", "src/b.py") in tc()
    assert tc("--since", "1m") == {("src/a.py", "src/c.py"): 1}


def test_owners_that_may_differ(repo):
    """Paths between two commits, along branches, merges, reverts and unrelated or lost commits."""
    def commit(name, files):
        write(repo, files)
        git(repo, "add", "-A")
        git(repo, "commit", "-m", name, "--allow-empty")
        return git_history.commit_of(str(repo), "HEAD")

    between = lambda old, new: touched(str(repo), old, new)
    first = git_history.commit_of(str(repo), "HEAD")
    assert between(first, first) == set() and between("0" * 40, first) is None
    git(repo, "checkout", "-b", "side")
    commit("side", {"side.py": "s = 1\n"})
    git(repo, "checkout", "main")
    commit("change", {"src/a.py": "changed\n"})
    back = commit("change back", {"src/a.py": subprocess.run(["git", "-C", str(repo), "show", f"{first}:src/a.py"], capture_output=True).stdout})
    one = commit("one", {"one.py": "o = 1\n"})
    assert between(back, one) == {"one.py"} and between(first, back) == {"src/a.py"}
    git(repo, "merge", "side", "-m", "merge")
    merged = git_history.commit_of(str(repo), "HEAD")
    # the branch began before: what changed since then may have other owners by way of it
    assert between(one, merged) == {"side.py", "one.py", "src/a.py"}
    assert between(merged, one) == between(one, merged)
    moved = commit("moved", {"line\nbreak.py": "x\n", "é.py": "x\n"})
    assert between(merged, moved) == {"line\nbreak.py", "é.py"}
    assert between(moved, commit("names", {".mailmap": "Eve <eve@example.org> <ann@example.org>\n"})) is None
    git(repo, "checkout", "--orphan", "new")
    assert between(moved, commit("apart", {"x.py": "x\n"})) is None


def test_owners_kept_between_runs(spark, repo, tmp_path, monkeypatch):
    """Later calls ask about changed files only and give what a whole reading gives."""
    asked_for = []
    real = git_history.history_table

    def spy(spark, path, table, ref="HEAD", since_ref=None):
        if table == "hunks":
            asked_for.append(sorted(p for _, p in asked(path, table, ref=ref, **({"since_ref": since_ref} if since_ref else {}))[0]))
        return real(spark, path, table, ref, since_ref)

    monkeypatch.setattr(git_history, "history_table", spy)
    folder = str(tmp_path / "kept")
    rows = lambda df: sorted(map(tuple, df.collect()))

    def same():
        found = kept_hunks(spark, str(repo), folder)
        assert rows(found) == rows(real(spark, str(repo), "hunks"))
        assert found.columns == real(spark, str(repo), "hunks").columns
        return asked_for.pop() if asked_for else None

    assert same() == ["src/a.py", "src/c.py", "src/é x.py"]
    assert same() is None  # nothing changed: nothing is asked
    write(repo, {"src/a.py": "def f(a):\n    return 3\n", "src/new.py": "n = 1\n"})
    git(repo, "rm", "src/c.py")
    git(repo, "mv", "src/é x.py", "src/x.py")
    git(repo, "add", "-A")
    git(repo, "commit", "-m", "four", who="Cid")
    assert same() == ["src/a.py", "src/new.py", "src/x.py"]
    write(repo, {"src/new.py": "n = 1\nm = 2\n"})
    git(repo, "commit", "-am", "five", who="Dan")
    assert same() == ["src/new.py"] and same() is None
    below = kept_hunks(spark, str(repo / "src"), folder)
    assert rows(below) == rows(real(spark, str(repo / "src"), "hunks"))
    for left in (tmp_path / "kept").rglob("part-*.parquet"):
        os.remove(left)
    for table in [d for d in (tmp_path / "kept").glob("*/*") if d.name != "index"]:
        os.rename(table, tmp_path / table.name)
    asked_for.clear()
    assert same() == ["src/a.py", "src/new.py", "src/x.py"]  # the tables are gone
    assert cli.main(["authors", str(repo), "--keep-ownership", folder, "--format", "terse"], spark) == 0


def test_bare_repositories_are_rejected(tmp_path):
    git(tmp_path, "init", "--bare")
    with pytest.raises(ValueError, match="bare"):
        repository(str(tmp_path))


def test_imports(spark):
    rows = [("src/main.rs", "Rust", "mod net;\npub(crate) mod util;\nmod gone;"), ("src/net.rs", "Rust", "mod tcp;"), ("src/net/tcp.rs", "Rust", ""), ("src/util/mod.rs", "Rust", ""), ("p/a.py", "Python", "from . import b, c\nfrom .q.r import z\nimport os\nfrom ..x import y"), ("p/b.py", "Python", ""), ("p/q/r/__init__.py", "Python", ""), ("x.py", "Python", ""), ("w/i.ts", "TypeScript", "import {a} from './j';\nconst k = require('./k/');\nimport './l.js'\nimport x from 'react'"), ("w/j.tsx", "TypeScript", ""), ("w/k/index.js", "JavaScript", ""), ("w/l.ts", "TypeScript", ""), ("cmd/m.go", "Go", 'import (\n\t"fmt"\n\tz "ex.org/m/lib"\n)'), ("lib/n.go", "Go", 'import "ex.org/m/cmd"'), ("lib/n_test.go", "Go", "")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    got = {tuple(r) for r in dependencies.import_edges(files, "ex.org/m").collect()}
    assert got == {("src/main.rs", "src/net.rs"), ("src/main.rs", "src/util/mod.rs"), ("src/net.rs", "src/net/tcp.rs"), ("p/a.py", "p/b.py"), ("p/a.py", "p/q/r/__init__.py"), ("p/a.py", "x.py"), ("w/i.ts", "w/j.tsx"), ("w/i.ts", "w/k/index.js"), ("w/i.ts", "w/l.ts"), ("cmd/m.go", "lib/n.go"), ("lib/n.go", "cmd/m.go")}


def test_commands(spark, repo, capsys):
    def out(*args):
        code = cli.main([args[0], str(repo), *args[1:]], spark)
        return code, capsys.readouterr().out

    counts = {"files": 3, "blank": 0, "comment": 0, "code": 6}
    assert json.loads(out("loc", "--format", "json")[1]) == {"languages": [{"language": "Python"} | counts], "totals": counts}
    by = {r["email"]: r["code"] for r in json.loads(out("loc", "--by-author", "--format", "json")[1])["authors"]}
    assert by == {"ann@example.org": 3, "bob@example.org": 3}
    assert json.loads(out("cycom", "--format", "json")[1])[0] == {"path": "src/a.py", "language": "Python", "function_count": 1, "avg_complexity": 3.0, "max_complexity": 3, "total_complexity": 3, "level": "simple", "functions": [{"name": "f", "start_line": 1, "complexity": 3, "level": "simple"}]}
    assert "line=1,title=Cognitive Complexity" in out("cogcom", "--format", "github", "--min-complexity", "2")[1]
    assert json.loads(out("cycom", "--format", "gitlab")[1])[0]["severity"] == "info"
    assert out("loc", "--format", "github")[0] == 1
    for command in ("dups", "indent", "hal", "mi", "miv", "churn", "hotspots", "knowledge", "tc", "age", "authors", "deps", "smells"):
        assert out(command)[0] == 0, command
    assert [s["section"] for s in json.loads(out("report", "--format", "json")[1])][:2] == ["loc", "duplication"]
    assert "Score" in out("score")[1]
    diff = json.loads(out("score", "--trend", "HEAD~2", "--format", "json")[1])
    assert diff["git_ref"] == "HEAD~2" and (diff["before"]["files"], diff["after"]["files"], diff["after"]["loc"]) == (2, 3, 6)
    assert [d["name"] for d in diff["dimensions"]] == ["Cognitive Complexity", "Duplication", "Indentation Complexity", "Halstead Effort", "File Size"]
    assert out("score", "--trend", "--fail-below", "A++")[0] == (0 if diff["after"]["grade"] == "A++" else 1)
    assert cli.main(["score", "diff", str(repo), "--git-ref", "HEAD~2", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == diff
    assert cli.main(["score", "diff", str(repo), "--format", "short"], spark) == 0
    assert capsys.readouterr().out.startswith("score-diff ref:HEAD before:")
    assert out("init", "--yes")[0] == 0
    assert config.project_file(str(repo), None)["smells"]["max_lines"] == 20


def test_one_line_and_json(spark, repo, capsys):
    """The values of `short` and `terse` and the shapes of JSON, of every command."""

    def out(*args):
        assert cli.main([args[0], str(repo), *args[1:]], spark) == 0, args
        return capsys.readouterr().out.rstrip("\n")

    write(repo, {"src/s.py": "def g(a, b, c, d, e):\n    # TODO later\n    return a + 42\n", "src/copy.py": "y = 1\n", "src/bin.py": b"\0\1"})
    git(repo, "add", "-A")
    git(repo, "commit", "-m", "four", when="2024-06-01T00:00:00Z")
    short = lambda *args: out(*args, "--format", "short")
    terse = lambda *args: out(*args, "--format", "terse")
    assert short("loc") == "loc code:8 cmt:1 blank:0 files:4 langs:1" and terse("loc") == "8"
    assert out("loc", "--verbose").splitlines()[:4] == ["       6 text files.", "       4 unique files.", "       1 files ignored (duplicates).", "       1 files ignored (binary)."]
    assert short("loc", "--by-author") == "loc_authors code:9 cmt:1 blank:0 authors:2" and terse("loc", "--by-author") == "9"
    assert short("cycom") == "cycom files:5 fns:5 avg:1.4 max:3 total:7" and terse("cycom") == "1.4"
    assert short("cogcom") == "cogcom files:5 fns:5 avg:0.4 max:2 total:2"
    hal = json.loads(out("hal", "--format", "json"))
    assert terse("hal") == f"{sum(r['effort'] for r in hal):.1f}" and short("hal").startswith(f"hal files:{len(hal)} vol:{sum(r['volume'] for r in hal):.1f} effort:")
    mi = json.loads(out("mi", "--format", "json"))
    assert terse("mi") == f"{sum(r['mi_score'] for r in mi) / len(mi):.1f}" and short("mi").endswith("green:5 yellow:0 red:0") and mi[0]["level"] == "green"
    miv = json.loads(out("miv", "--format", "json"))
    assert list(miv[0]) == ["path", "language", "halstead_volume", "cyclomatic_complexity", "loc", "comment_lines", "comment_percent", "mi_woc", "mi_cw", "mi_score", "level"]
    assert short("miv") == f"miv files:5 avg:{sum(r['mi_score'] for r in miv) / 5:.1f} good:5 mod:0 diff:0"
    assert short("dups") == "dups dup:0.0% lines:0 groups:0" and json.loads(out("dups", "--format", "json"))["metrics"]["assessment"] == "Excellent"
    assert short("indent").startswith("indent files:5 avg_sd:") and short("indent").endswith("max_depth:2")
    assert short("churn") == "churn files:6 total_commits:7 top:src/a.py" and terse("churn") == "7"
    first = json.loads(out("churn", "--format", "json"))[0]
    assert first == {"path": "src/a.py", "language": "Python", "commits": 2, "rate_per_month": 1.0, "first_commit": "2024-01-01", "last_commit": "2024-03-01", "level": "MEDIUM"}
    assert short("hotspots", "--complexity", "cycom") == "hotspots top:src/a.py score:6 commits:2 cx:3" and terse("hotspots", "--complexity", "cycom") == "src/a.py"
    assert json.loads(out("hotspots", "--format", "json"))[0]["complexity_metric"] == "indent"
    assert short("knowledge").startswith("knowledge files:") and terse("knowledge", "--bus-factor") == "2"
    assert list(json.loads(out("knowledge", "--bus-factor", "--format", "json"))) == ["factor", "threshold", "total_lines", "contributors"]
    assert short("knowledge", "--summary").startswith("knowledge-summary authors:")
    assert short("tc") == "tc pairs:0 max_strength:0.00" and terse("tc") == "0"
    assert short("tc", "--min-degree", "1") == "tc pairs:6 strong:6 max_strength:1.00"
    assert json.loads(out("tc", "--min-degree", "1", "--format", "json"))[0]["level"] == "STRONG"
    assert short("age") == "age files:6 active:0 stale:0 frozen:6" and json.loads(out("age", "--format", "json"))[0]["last_modified"].startswith("2024-")
    assert short("authors").startswith("authors count:2 files:") and terse("authors") == "2"
    assert short("smells") == "smells files:1 total:3" and terse("smells") == "3"
    assert json.loads(out("smells", "--format", "json")) == [{"path": "src/s.py", "language": "Python", "total": 3, "smells": [{"kind": "long_parameter_list", "line": 1, "detail": "function `g` has 5 params (max 4)"}, {"kind": "todo_debt", "line": 2, "detail": "TODO comment"}, {"kind": "magic_number", "line": 3, "detail": "magic number in code"}]}]
    assert "title=TODO/FIXME Debt::TODO comment" in out("smells", "--format", "github")
    found = json.loads(out("score", "--format", "json"))
    assert list(found) == ["target", "score", "grade", "files_analyzed", "total_loc", "dimensions", "needs_attention"] and terse("score") == f"{found['score']:.1f}"
    assert short("score") == f"score s:{found['score']:.1f} g:{found['grade']} files:{found['files_analyzed']} loc:{found['total_loc']} " + " ".join(f"{d['name'].split()[0].lower()}:{d['score']:.1f}" for d in found["dimensions"])
    assert short("report") == "report files:4 langs:1 code:8 dups:0.0%" and terse("report") == "8"
    assert short("deps").startswith("deps files:")
    assert out("loc", "--list-excluded", "--exclude", "src/s*").endswith("1 file(s) excluded")


def test_settings(tmp_path):
    (tmp_path / "codeseam.toml").write_text("[smells]\nmax_lines = 70\n")
    project = config.project_file(str(tmp_path), None)
    assert config.setting("smells", "max_lines", None, project) == 70
    assert config.setting("smells", "max_lines", 9, project) == 9
    assert config.setting("smells", "max_params", None, project) == 4
    (tmp_path / "codeseam.toml").write_text("[smells")
    assert config.project_file(str(tmp_path), None) == {}
    assert config.seconds_of("2 months") == 60 * 86_400 and config.since("1y", 400 * 86_400) == 35 * 86_400
    for bad in ("", "6", "m", "6w", "-1d"):
        with pytest.raises(ValueError):
            config.seconds_of(bad)
    with pytest.raises(ValueError, match="1970"):
        config.since("1y", 100)
