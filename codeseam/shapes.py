"""What commands print in one line or as JSON, from the rows of their results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .report import rows_of

SUMS = {k: f"coalesce(sum({k}), 0)" for k in ("files", "blank", "comment", "code")}
COMPLEXITY = {"files": "count(*)", "fns": "coalesce(sum(functions), 0)", "avg": "coalesce(sum(total) / sum(functions), 0D)", "max": "coalesce(max(max), 0)", "total": "coalesce(sum(total), 0)"}


def counts(column: str, **levels: str) -> dict[str, str]:
    return {k: f"count_if({column} = '{v}')" for k, v in levels.items()}


#: View -> the line of `short`, the value of `terse`, what they show as SQL over the
#: result (none: the command gives the values).
HEADLINES: dict[str, tuple[str, str, dict[str, str]]] = {
    "loc": ("loc code:{code} cmt:{comment} blank:{blank} files:{files} langs:{langs}", "{code}", {k: f"coalesce(sum({k}) filter (where language is not null), 0)" for k in SUMS} | {"langs": "count(language)"}),
    "loc_authors": ("loc_authors code:{code} cmt:{comment} blank:{blank} authors:{authors}", "{code}", SUMS | {"authors": "count(*)"}),
    "dups": ("dups dup:{duplication_percentage:.1f}% lines:{duplicated_lines} groups:{duplicate_groups}", "{duplication_percentage:.1f}", {}),
    "indent": ("indent files:{files} avg_sd:{avg:.2f} max_sd:{max_sd:.2f} max_depth:{max_depth}", "{avg:.2f}", {"files": "count(*)", "avg": "coalesce(avg(indent_stddev), 0D)", "max_sd": "coalesce(max(indent_stddev), 0D)", "max_depth": "coalesce(max(indent_max), 0)"}),
    "hal": ("hal files:{files} vol:{volume:.1f} effort:{effort:.1f} bugs:{bugs:.1f}", "{effort:.1f}", {"files": "count(*)"} | {k: f"coalesce(sum({k}), 0D)" for k in ("volume", "effort", "bugs")}),
    "cycom": ("cycom files:{files} fns:{fns} avg:{avg:.1f} max:{max} total:{total}", "{avg:.1f}", COMPLEXITY),
    "cogcom": ("cogcom files:{files} fns:{fns} avg:{avg:.1f} max:{max} total:{total}", "{avg:.1f}", COMPLEXITY),
    "mi": ("mi files:{files} avg:{avg:.1f} green:{green} yellow:{yellow} red:{red}", "{avg:.1f}", {"files": "count(*)", "avg": "coalesce(avg(mi_score), 0D)"} | counts("mi_level", green="green", yellow="yellow", red="red")),
    "miv": ("miv files:{files} avg:{avg:.1f} good:{good} mod:{mod} diff:{diff}", "{avg:.1f}", {"files": "count(*)", "avg": "coalesce(avg(miv_score), 0D)"} | counts("miv_level", good="good", mod="moderate", diff="difficult")),
    "report": ("report files:{files} langs:{langs} code:{code} dups:{duplication_percentage:.1f}%", "{code}", {}),
    "churn": ("churn files:{files} total_commits:{commits} top:{top}", "{commits}", {"files": "count(*)", "commits": "coalesce(sum(commits), 0)"}),
    "hotspots": ("hotspots top:{path} score:{score} commits:{commits} cx:{complexity}", "{path}", {}),
    "knowledge": ("knowledge files:{files} critical:{critical} loss_risk:{loss}", "{critical}", {"files": "count(*)", "critical": "count_if(risk = 'CRITICAL')", "loss": "count_if(knowledge_loss)"}),
    "knowledge_summary": ("knowledge-summary authors:{authors} files:{files} loss_risk:{loss}", "{authors}", {"authors": "count(*)", "files": "coalesce(sum(files_owned), 0)", "loss": "coalesce(sum(knowledge_loss_files), 0)"}),
    "bus_factor": ("bus-factor factor:{factor} contributors:{contributors} lines:{lines}", "{factor}", {"factor": "count_if(is_critical)", "contributors": "count(*)", "lines": "coalesce(sum(lines), 0)"}),
    "tc": ("tc pairs:{pairs} strong:{strong} max_strength:{strength:.2f}", "{pairs}", {"strong": "count_if(strength >= 0.5)", "strength": "coalesce(max(strength), 0D)"}),
    "tc_none": ("tc pairs:0 max_strength:0.00", "0", {}),
    "smells": ("smells files:{files} total:{total}", "{total}", {"files": "count(*)", "total": "coalesce(sum(total), 0)"}),
    "score": ("score s:{score:.1f} g:{grade} files:{files_analyzed} loc:{total_loc} {parts}", "{score:.1f}", {}),
    "score_diff": ("score-diff ref:{ref} before:{before:.1f} after:{after:.1f} delta:{delta:+.1f} grade:{grade}", "{delta:+.1f}", {}),
    "age": ("age files:{files} active:{active} stale:{stale} frozen:{frozen}", "{frozen}", {"files": "count(*)"} | counts("status", active="ACTIVE", stale="STALE", frozen="FROZEN")),
    "authors": ("authors count:{authors} files:{files} lines:{lines}", "{authors}", {"authors": "count(*)", "files": "coalesce(sum(owned_files), 0)", "lines": "coalesce(sum(lines), 0)"}),
    "deps": ("deps files:{files} cyclic:{cyclic}", "{files}", {"files": "count(*)", "cyclic": "count(cycle)"}),
    "init": ("init max_lines:{max_lines} max_params:{max_params} max_dup_ratio:{max_dup_ratio:.1f}", "{path}", {k: f"any_value({k})" for k in ("max_lines", "max_params", "max_dup_ratio", "path")}),
}


def day(column: str) -> str:
    """The UTC date of a time, as text."""
    return f"date_format(to_utc_timestamp({column}, current_timezone()), 'yyyy-MM-dd')"


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


PER_FILE = same("path", "language") | {"function_count": "functions", "avg_complexity": "avg", "max_complexity": "max", "total_complexity": "total"} | same("level")
INDEX = same("path", "language") | {"halstead_volume": "volume", "cyclomatic_complexity": "total_complexity", "loc": "code"}

#: View -> the fields of an entry in JSON, as SQL over the result.
FIELDS: dict[str, dict[str, str]] = {
    "loc": same("language", "files", "blank", "comment", "code"),
    "loc_authors": same("name", "email", "files", "blank", "comment", "code"),
    "indent": same("path", "code_lines", "indent_stddev", "indent_max", "complexity"),
    "hal": same("path", "language", "distinct_operators", "distinct_operands", "total_operators", "total_operands", "vocabulary", "length", "volume", "difficulty", "effort", "bugs", "time"),
    "cycom": PER_FILE,
    "cogcom": PER_FILE,
    "mi": INDEX | {"mi_score": "mi_score", "level": "mi_level"},
    "miv": INDEX | {"comment_lines": "comment", "comment_percent": "if(code + comment > 0, comment * 100D / (code + comment), 0D)", "mi_woc": "mi_woc", "mi_cw": "mi_cw", "mi_score": "miv_score", "level": "miv_level"},
    "churn": same("path", "language", "commits") | {"rate_per_month": "round(rate_per_month, 2)", "first_commit": day("first_ts"), "last_commit": day("last_ts"), "level": "level"},
    "hotspots": same("path", "language", "commits", "complexity", "complexity_metric", "score"),
    "knowledge": same("path", "language", "total_lines", "primary_owner") | {"ownership_pct": "round(ownership_pct, 1)"} | same("contributors", "risk", "knowledge_loss"),
    "knowledge_summary": same("author", "files_owned", "total_lines", "languages", "worst_risk", "knowledge_loss_files"),
    "bus_factor": same("author", "lines") | {"pct": "round(pct, 2)", "cumulative_pct": "round(cumulative_pct, 2)", "is_critical": "is_critical"},
    "tc": same("file_a", "file_b", "shared_commits", "commits_a", "commits_b") | {"strength": "round(strength, 2)", "level": "level"},
    "smells": same("path", "language", "smells", "total"),
    "score": same("name", "weight", "score", "grade"),
    "score_diff": same("name", "weight", "before_score", "before_grade", "after_score", "after_grade", "delta"),
    "score_file": same("path", "score", "grade", "issues"),
    "age": same("path", "language") | {"last_modified": day("last_ts"), "age_days": "age_days", "status": "status"},
    "authors": same("name", "email", "owned_files", "lines", "languages") | {"last_active": day("last_active")},
}


def values(view: str, result: DataFrame) -> dict[str, Any]:
    """What a headline shows of a result: one row, whatever the size of the result."""
    shown = HEADLINES[view][2]
    return result.agg(*(F.expr(e).alias(k) for k, e in shown.items())).first().asDict() if shown else {}


def headline(view: str, of: dict[str, Any], terse: bool) -> str:
    return HEADLINES[view][terse].format(**of)


def entries(view: str, result: DataFrame) -> list[dict]:
    """The rows of a small result as JSON has them; results of other commands as they are."""
    fields = FIELDS.get(view)
    return rows_of(result.select(*(F.expr(e).alias(k) for k, e in fields.items())) if fields else result)


def with_totals(name: str, rows: list[dict]) -> dict[str, Any]:
    """Line counts by language or author, and their sums."""
    return {name: rows, "totals": {k: sum(r[k] for r in rows) for k in ("files", "blank", "comment", "code")}}


def of_authors(rows: list[dict]) -> dict[str, Any]:
    """The bus factor (how many authors it takes) with their shares."""
    return {"factor": sum(r["is_critical"] for r in rows), "threshold": 80.0, "total_lines": sum(r["lines"] for r in rows), "contributors": rows}
