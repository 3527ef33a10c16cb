"""Functions of source files with their cyclomatic and cognitive complexity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, groupby

from .rules import CONTROL, Rules


#: Bytes of words (ASCII letters, digits, underscores) as they are, others blank.
WORD = bytes(b if b < 128 and (chr(b).isalnum() or b == 95) else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The longest runs of ASCII letters, digits and underscores."""
    return text.translate(WORD).split()


def any_of(words: tuple[str, ...]) -> re.Pattern:
    """Longest first; words stand alone, symbols anywhere. Every one begins with its first letter,
    and what may not be before it comes after that, so that a search can skip to such letters."""
    alone = lambda w: rf"{w[0]}(?<![A-Za-z0-9_]{w[0]}){re.escape(w[1:])}(?![A-Za-z0-9_])"
    parts = (alone(w) if w[0].isalpha() else re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return re.compile("|".join(parts) or "(?!)")


@cache
def _patterns(rules: Rules) -> dict[str, re.Pattern]:
    strings = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)' + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?$)"
    return {
        "mask": re.compile(f"({strings})" + (f"|{re.escape(rules.comment)}.*$" if rules.comment else "")),
        "branches": any_of(rules.branches),
        "chained": any_of(rules.chained),
        "nesting": any_of(rules.nesting),
        "otherwise": any_of(rules.otherwise),
        "joins": re.compile("|".join([any_of(rules.joins).pattern, *map(re.escape, "();{},")])),
    }


@cache
def _begins(rules: Rules) -> dict[str, tuple[frozenset[bytes], frozenset[str]]]:
    """For each kind of marker the words, and the symbols, of which a line with one has one."""
    groups = {k: getattr(rules, k) for k in ("branches", "chained", "nesting", "otherwise", "joins")}
    return {k: (frozenset(words_of(w.encode())[0] for w in of if w[0].isalpha()), frozenset(w for w in of if not w[0].isalpha())) for k, of in groups.items()}


def masked(line: str, rules: Rules) -> str:
    """The line without its comment, and with the insides of strings blanked."""
    return masked_lines([line], rules)[0]


def masked_lines(lines: list[str], rules: Rules) -> list[str]:
    """masked() of many lines."""

    def blank(m: re.Match) -> str:
        s = m[1] or ""
        closed = len(s) > 1 and s[-1] == s[0]
        return s and s[0] + " " * (len(s) - 1 - closed) + s[0] * closed

    sub = _patterns(rules)["mask"].sub
    # what begins none of these leaves the line as it is
    return [sub(blank, x) if '"' in x or "'" in x or (rules.comment and rules.comment in x) else x for x in lines]


#: Different lines whose facts a task remembers, and the length of a line up to which it does.
REMEMBERED, SHORT = 20_000, 200


class Facts(dict):
    """masked line -> (branches, nests, other flow: 2, chained: 1, runs of joins, braces) by a
    language's rules, remembered for short lines: those of files are often the same."""

    def __init__(self, rules: Rules):
        super().__init__()
        self.find, self.begins = _patterns(rules), _begins(rules)
        self.words, self.symbols = (frozenset().union(*own) for own in zip(*self.begins.values(), strict=True))
        self.braces = rules.braces

    def __missing__(self, mask: str) -> tuple[int, bool, int, int, str]:
        # a marker is looked for only in lines with its first word, or with the symbol
        words = self.words.intersection(words_of(mask.encode("utf-8", "surrogatepass")))
        symbols = [x for x in self.symbols if x in mask]
        find = {k: self.find[k] for k, (own, marks) in self.begins.items() if not own.isdisjoint(words) or not marks.isdisjoint(symbols)} if words or symbols else {}
        chained = "chained" in find and find["chained"].search(mask)
        nests = not chained and "nesting" in find and find["nesting"].search(mask)
        flat = not chained and not nests and "otherwise" in find and find["otherwise"].search(mask)
        joins = sum(1 for token, _ in groupby(find["joins"].findall(mask)) if token not in "();{},") if "joins" in find else 0
        braces = "".join(re.findall("[{}]", mask)) if self.braces else ""
        out = len(find["branches"].findall(mask)) if "branches" in find else 0, bool(nests), 2 if flat else 1 if chained else 0, joins, braces
        if len(mask) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[mask] = out
        return out


@cache
def facts(rules: Rules) -> Facts:
    return Facts(rules)


def indent(line: str) -> int:
    if line[:1] not in (" ", "\t"):
        return 0
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def starts_function(text: str, rules: Rules) -> bool:
    if rules.starts:
        return any(m in text for m in rules.starts) if rules.braces else text.startswith(rules.starts)
    if not rules.braces or text.startswith("#") or "(" not in text or text[-1:] not in ("{", ")"):
        return False
    return text.split()[0].lstrip("*") not in CONTROL


def function_name(text: str, rules: Rules) -> str:
    for marker in rules.starts:
        if m := re.search(re.escape(marker) + r"(\w+)", text):
            return m[1]
    words = text.partition("(")[0].split() if "(" in text else []
    return (words and words[-1].lstrip("*")) or "<anonymous>"


def spans(texts: list[str], masks: list[str], rules: Rules) -> Iterator[tuple[int, int]]:
    """(first, past the last) code line of every outermost function.

    In languages with braces, a function ends where the depth is again what it was before it,
    once a brace was opened; otherwise before the next line that is not indented deeper.
    """
    depth = [0, *accumulate(m.count("{") - m.count("}") for m in masks)] if rules.braces else []
    opened = [0, *accumulate(m.count("{") for m in masks)] if rules.braces else []
    depths = [] if rules.braces else [indent(t) for t in texts]
    i = 0
    while i < len(texts):
        if not starts_function(texts[i].strip(), rules):
            i += 1
            continue
        rest = range(i + 1, len(texts) + 1)
        if rules.braces:
            end = next((j for j in rest if opened[j] > opened[i] and depth[j] == depth[i]), len(texts))
        else:
            end = next((j for j in rest if j < len(texts) and depths[j] <= depths[i]), len(texts))
        yield i, end
        i = end


def cognitive(texts: list[str], found: list[tuple], rules: Rules) -> int:
    """From a function's lines and their facts. Flow lines count one, and those that nest the depth of nesting too; every run of one kind
    of boolean operator counts one. Depth comes from the braces that flow lines open, or from
    the indentation under the first line, which itself counts only in languages with braces."""
    total = 0
    open_braces: list[bool] = []
    pending, body = False, True
    base = indent(texts[0]) + 4 if texts else 0
    for at, (text, (_, nests, flow, joins, braces)) in enumerate(zip(texts, found, strict=True)):
        if not rules.braces and not at:
            continue
        if nests:
            total += 1 + (sum(open_braces) if rules.braces else max(0, indent(text) - base) // 4)
        total += (flow > 0) + joins
        pending = nests or flow == 2
        for brace in braces:
            if brace == "}":
                if open_braces:
                    open_braces.pop()
            else:
                open_braces.append(pending and not body)
                pending, body = pending and body, False
    return total


def parameters(masks: list[str]) -> int:
    """Commas of the first parenthesis, over as many lines as it takes, plus one; 0 if it is empty
    or never closed."""
    text = "\n".join(masks)
    start = text.find("(")
    if start < 0:
        return 0
    depth = 0
    for end in range(start, len(text)):
        depth += (text[end] == "(") - (text[end] == ")")
        if not depth:
            break
    else:
        return 0
    inside = text[start + 1 : end].strip()
    inside = inside.rstrip(",").rstrip()
    return inside.count(",") + 1 if inside else 0


def file_functions(lines: list[str], code: list[int], masks: list[str], rules: Rules) -> list[tuple]:
    """(name, start_line, n_lines, code_lines, n_params, cyclomatic, cognitive) of a file's
    functions, from its lines, the numbers of its code lines and these masked.

    Code outside functions does not count; a file without functions is one called <file>.
    """
    texts = [lines[k] for k in code]
    of = facts(rules)
    found = [of[m] for m in masks]
    count = lambda lo, hi: 1 + sum(f[0] for f in found[lo:hi])
    out = []
    for lo, hi in spans(texts, masks, rules):
        out.append((function_name(texts[lo].strip(), rules), code[lo] + 1, code[hi - 1] - code[lo] + 1, hi - lo, parameters(masks[lo:hi]), count(lo, hi), cognitive(texts[lo:hi], found[lo:hi], rules)))
    if not out and code:
        out.append(("<file>", 1, len(lines), len(code), 0, count(0, len(code)), cognitive(texts, found, rules)))
    return out
