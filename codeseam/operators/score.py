"""Health score: file metrics to dimensions, grades, worst files, differences and gates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import GRADES, LAST_GRADE, curve, grade
from .metrics import all_measures


@dataclass(frozen=True)
class Model:
    """A scoring model: weights of the dimensions in the order of reports, and their names.
    Duplication is a project's, the others are files'."""

    weights: dict[str, float]
    #: a file is scored only if one of these is known of it
    needs: tuple[str, ...]

    @property
    def of_files(self) -> list[str]:
        return [k for k in self.weights if k != "duplication"]


#: Weights of the models, names of the dimensions, what a missing one scores, what
#: is an issue of a file.
MODELS = {
    "cogcom": Model({"cognitive": 0.30, "duplication": 0.20, "indent": 0.15, "effort": 0.20, "size": 0.15}, ("max_cognitive",)),
    "legacy": Model({"mi": 0.30, "cyclomatic": 0.20, "duplication": 0.15, "indent": 0.15, "effort": 0.15, "size": 0.05}, ("miv_score", "max_cyclomatic")),
}
NAMES = {"cognitive": "Cognitive Complexity", "mi": "Maintainability Index", "cyclomatic": "Cyclomatic Complexity", "duplication": "Duplication", "indent": "Indentation Complexity", "effort": "Halstead Effort", "size": "File Size"}
MISSING, ISSUE_BELOW, LARGE_FILE = 50.0, 60.0, 1000
LABELS = {"cognitive": ("Cognitive: %d", "max_cognitive"), "mi": ("MI: %.1f", "miv_score"), "cyclomatic": ("Complexity: %d", "max_cyclomatic"), "indent": ("Indent: %.1f", "indent_stddev"), "effort": ("Effort: %.0f", "effort")}


def file_scores(measures: DataFrame, model: str = "cogcom") -> DataFrame:
    """Scores of each file's dimensions, from wide rows, row by row; null where the metric is
    unknown. Files without a metric of the model are no code and are left out."""
    m = MODELS[model]
    per_line = F.when((F.col("effort") > 0) & (F.col("code") > 0), curve("effort", F.col("effort") / F.col("code"))).when(F.col("effort").isNotNull(), MISSING)
    values = {"cognitive": curve("cognitive", F.col("max_cognitive")), "mi": curve("mi", F.col("miv_score")), "cyclomatic": curve("cyclomatic", F.col("max_cyclomatic")), "indent": curve("indent", F.col("indent_stddev")), "effort": per_line, "size": curve("size", F.col("code"))}
    label = lambda k: F.when(values[k] < ISSUE_BELOW, F.format_string(LABELS[k][0], LABELS[k][1]))
    issues = F.array(*(label(k) for k in m.of_files if k in LABELS), F.when(F.col("code") > LARGE_FILE, F.format_string("Size: %d LOC", "code")))
    known = reduce(lambda a, c: a | F.col(c).isNotNull(), m.needs, F.lit(False))
    rows = all_measures(measures).where(known)
    return rows.select("path", "code", "n_normalized", *(values[k].alias(k) for k in m.of_files), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def dimensions(scores: DataFrame, duplication_pct: DataFrame, model: str = "cogcom") -> DataFrame:
    """(position, name, weight, score, grade): means weighted by code lines, at least one a file;
    nulls do not count, and nothing scores 0. duplication_pct has one row."""
    m = MODELS[model]
    w = F.greatest(F.col("code"), F.lit(1))
    mean = lambda c: F.when(F.sum("code") > 0, F.coalesce(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0))).otherwise(0.0)
    one = scores.agg(*(mean(c).alias(c) for c in m.of_files)).join(F.broadcast(duplication_pct.select(curve("duplication", F.col("duplication_percentage")).alias("duplication"))))
    rows = F.inline(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(k).alias("name"), F.lit(v).alias("weight"), F.col(k).alias("score")) for i, (k, v) in enumerate(m.weights.items()))))
    return one.select(rows).withColumn("grade", grade(F.col("score")))


def project(dims: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row: score, grade, and, with the files' scores, files_analyzed and total_loc (a project
    without files scores 0)."""
    out = dims.agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
    if scores is not None:
        sizes = scores.agg(F.count("*").alias("files_analyzed"), F.coalesce(F.sum("code"), F.lit(0)).alias("total_loc"))
        out = out.join(F.broadcast(sizes)).withColumn("score", F.when(F.col("files_analyzed") > 0, F.col("score")).otherwise(0.0))
    return out.withColumn("grade", grade(F.col("score")))


def total_score(model: str) -> Column:
    m = MODELS[model]
    return reduce(lambda a, k: a + F.coalesce(F.col(k), F.lit(MISSING)) * m.weights[k], m.of_files, F.lit(0.0)) / sum(m.weights[k] for k in m.of_files)


def worst_files(scores: DataFrame, bottom: int = 10, model: str = "cogcom") -> DataFrame:
    """The files with the lowest scores: a report of `bottom` rows. A missing dimension is 50."""
    out = scores.select("path", total_score(model).alias("score"), F.col("code").alias("loc"), "issues")
    return out.withColumn("grade", grade(F.col("score"))).orderBy("score", "path").limit(bottom)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(position, name, weight, before_score, before_grade, after_score, after_grade, delta): two
    results of dimensions() of the same model side by side, with a last row `overall`."""

    def with_total(dims: DataFrame, side: str) -> DataFrame:
        # one aggregate of few rows, as a union would work the dimensions out twice
        row = F.struct("position", "name", "weight", "score", "grade")
        one = dims.agg(F.collect_list(row).alias("rows"), F.sum(F.col("score") * F.col("weight")).alias("score"))
        total = F.struct(F.lit(len(NAMES)).alias("position"), F.lit("overall").alias("name"), F.lit(1.0).alias("weight"), "score", grade(F.col("score")).alias("grade"))
        both = one.select(F.inline(F.concat("rows", F.array(total))))
        return both.select("position", "name", "weight", F.col("score").alias(f"{side}_score"), F.col("grade").alias(f"{side}_grade"))

    both = with_total(before, "before").join(with_total(after, "after"), ["position", "name", "weight"], "full")
    checked = F.when(F.col("before_score").isNull() | F.col("after_score").isNull(), F.raise_error(F.lit("the two scores are of different models")).cast("double"))
    return both.withColumn("delta", F.coalesce(checked, F.col("after_score") - F.col("before_score")))


def rank(name: str) -> int:
    """Place of a grade, 0 for the worst. Unknown names are an error."""
    order = [LAST_GRADE, *(g for _, g in reversed(GRADES))]
    return order.index(name.strip().upper())


class GateError(Exception):
    """A quality gate that did not hold."""


def check_score(before: float, after: float, after_grade: str, fail_if_worse: bool = False, fail_below: str | None = None) -> None:
    """Raises GateError if the score, to two decimals, dropped, or its grade is too low."""
    if fail_if_worse and half_up(after, 2) < half_up(before, 2):
        raise GateError(f"quality gate failed: score dropped {before:.2f} → {after:.2f} ({after - before:+.2f})")
    if fail_below and rank(after_grade) < rank(fail_below):
        raise GateError(f"quality gate failed: score {after_grade} is below minimum threshold {fail_below.strip().upper()}")


def check_duplication(groups: int, percent: float, max_groups: int | None = None, max_ratio: float | None = None, before: float | None = None) -> None:
    """Raises GateError if there are too many groups, too large a share of lines, or, at a
    hundredth of a per cent, a larger one than before."""
    if max_groups is not None and groups > max_groups:
        raise GateError(f"quality gate failed: {groups} duplicate groups found (max allowed: {max_groups})")
    if max_ratio is not None and percent > max_ratio:
        raise GateError(f"quality gate failed: {percent:.1f}% duplicated lines (max allowed: {max_ratio:.1f}%)")
    if before is not None and half_up(percent, 2) > half_up(before, 2):
        raise GateError(f"quality gate failed: duplication increased from {before:.2f}% to {percent:.2f}%")


def half_up(x: float, digits: int) -> float:
    scaled = abs(x) * 10**digits
    return (1 if x >= 0 else -1) * int(scaled + 0.5) / 10**digits
