"""Scoring curves, grades and levels as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (value, score) breakpoints of each curve.
CURVES = {
    "cognitive": [(4, 100), (9, 85), (14, 65), (24, 35), (50, 5), (100, 0)],
    "duplication": [(5, 100), (10, 80), (20, 40), (40, 10), (100, 0)],
    "indent": [(1, 100), (1.5, 80), (2, 50), (3, 20), (5, 0)],
    "effort": [(1000, 100), (5000, 70), (10000, 40), (20000, 0)],
    "size": [(500, 100), (1000, 60), (2000, 20), (4000, 0)],
    "mi": [(0, 0), (25, 20), (50, 60), (75, 90), (100, 100)],
    "cyclomatic": [(5, 100), (10, 85), (15, 65), (25, 35), (50, 5), (100, 0)],
}
#: Least score of each grade.
GRADES = [(97, "A++"), (93, "A+"), (90, "A"), (87, "A-"), (83, "B+"), (80, "B"), (77, "B-"), (73, "C+"), (70, "C"), (67, "C-"), (63, "D+"), (60, "D"), (57, "D-"), (50, "F"), (40, "F-")]
LAST_GRADE = "F--"


def curve(name: str, x: Column) -> Column:
    """Linear between the breakpoints, constant beyond them."""
    points = CURVES[name]
    out = F.lit(float(points[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x <= b, p + (x - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(x.isNull(), None).when(x <= points[0][0], float(points[0][1])).otherwise(out)


def grade(score: Column) -> Column:
    out = F.lit(LAST_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def level(x: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The first level whose upper bound holds x."""
    out = F.lit(last)
    for bound, name in reversed(bands):
        out = F.when(x <= bound, name).otherwise(out)
    return out
