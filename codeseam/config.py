"""Settings: what is given beats the project's file, and that the defaults; spans of time."""

from __future__ import annotations

import os
import re
import tomllib
from typing import Any

#: Defaults by section.
DEFAULTS: dict[str, dict[str, Any]] = {
    "dups": {"min_lines": 6, "max_duplicates": None, "max_dup_ratio": None},
    "smells": {"max_lines": 50, "max_params": 4},
    "score": {"model": "cogcom", "bottom": 10, "min_lines": 6, "fail_if_worse": False, "fail_below": None},
    "age": {"active_days": 90, "frozen_days": 365},
    "tc": {"min_degree": 3, "min_strength": 0.0},
    "cycom": {"min_complexity": 1},
    "cogcom": {"min_complexity": 1},
    "report": {"top": 20},
}
UNITS = {1: ("d", "day", "days"), 30: ("m", "mo", "month", "months"), 365: ("y", "yr", "year", "years")}


def project_file(path: str, root: str | None, name: str = "codeseam.toml") -> dict:
    """The settings file of a project: at the repository's root, else in the folder. One that is
    missing or wrong sets nothing."""
    try:
        with open(os.path.join(root or path, name), "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def setting(section: str, key: str, given: Any, project: dict) -> Any:
    if given is not None:
        return given
    own = project.get(section)
    if isinstance(own, dict) and key in own:
        return own[key]
    return DEFAULTS[section][key]


def seconds_of(span: str) -> int:
    """Seconds of a span such as 30d, 6m or 1y (months of 30 days, years of 365)."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([a-z]+)\s*", span)
    days = next((d for d, names in UNITS.items() if found and found[2] in names), None)
    if not days:
        raise ValueError(f"invalid span of time {span!r}: expected such as 30d, 6m or 1y")
    return int(found[1]) * days * 86_400


def since(span: str, now: int) -> int:
    """The moment a span before `now` (seconds since 1970); earlier than 1970 is an error."""
    at = now - seconds_of(span)
    if at < 0:
        raise ValueError(f"the span {span!r} begins before 1970")
    return at
