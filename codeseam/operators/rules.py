"""Fixed values by language: what branches, nests and joins, how functions start, and tokens."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Markers of a language: what branches, what nests, what joins, how functions start."""

    branches: tuple[str, ...]
    nesting: tuple[str, ...]
    chained: tuple[str, ...]
    joins: tuple[str, ...]
    starts: tuple[str, ...]
    braces: bool = True
    comment: str = "//"
    otherwise: tuple[str, ...] = ("else",)


@dataclass(frozen=True)
class Tokens:
    """Operator keywords, operator symbols (the longest that fits counts), and words that are
    neither operator nor operand."""

    keywords: tuple[str, ...]
    symbols: tuple[str, ...]
    ignored: tuple[str, ...]


def _of(branches: str, nesting: str, joins: str, starts: tuple[str, ...] = (), chained: str = "else if", otherwise: str = "else", **more) -> Rules:
    words = lambda s: tuple(s.split(", ")) if s else ()
    return Rules(words(branches), words(nesting), words(chained), tuple(joins.split()), starts, otherwise=words(otherwise), **more)


_C = _of("else if, if, for, while, do, switch, case, catch, &&, ||", "if, for, while, do, switch, catch", "&& ||")
_JS = _of("else if, if, for, while, do, switch, case, catch, &&, ||, ??", "if, for, while, do, switch, catch", "&& || ??", ("function ",))
_SHELL = _of("elif, if, for, while, until, case, &&, ||", "if, for, while, until, case", "&& ||", chained="elif", braces=False, comment="#")
_ELIXIR = _of("if, cond, case, for, rescue", "if, cond, case, for, rescue", "", ("defp ", "def "), "", braces=False, comment="#")
_OCAML = _of("if, match, with", "if, match", "", ("let ",), "", braces=False, comment="")
#: Markers by language.
RULES = {
    "Rust": _of("else if, if, for, while, loop, match, &&, ||", "if, for, while, loop, match", "&& ||", ("fn ",)),
    "Python": _of("elif, if, for, while, except, and, or", "if, for, while, except", "and or", ("async def ", "def "), "elif", braces=False, comment="#"),
    **dict.fromkeys(("JavaScript", "TypeScript"), _JS),
    **dict.fromkeys(("Java", "C#", "C", "C++", "Objective-C", "PHP", "Dart"), _C),
    "Go": _of("else if, if, for, switch, case, select, &&, ||", "if, for, switch, select", "&& ||", ("func ",)),
    "Ruby": _of("elsif, if, unless, for, while, until, when, rescue, &&, ||", "if, unless, for, while, until, rescue", "&& ||", ("def ",), "elsif", braces=False, comment="#"),
    "Kotlin": _of("else if, if, for, while, when, catch, &&, ||", "if, for, while, when, catch", "&& ||", ("fun ",)),
    "Swift": _of("else if, if, for, while, switch, case, catch, guard, &&, ||", "if, for, while, switch, catch, guard", "&& ||", ("func ",)),
    "Scala": _of("else if, if, for, while, match, case, catch, &&, ||", "if, for, while, match, catch", "&& ||", ("def ",)),
    **dict.fromkeys(("Bourne Shell", "Bourne Again Shell", "Zsh"), _SHELL),
    "Haskell": _of("if, case", "if, case", "", (), "", braces=False, comment="--"),
    **dict.fromkeys(("Elixir", "Elixir Script"), _ELIXIR),
    "Lua": _of("elseif, if, for, while", "if, for, while", "", ("function ",), "elseif", braces=False, comment="--"),
    "Perl": _of("elsif, if, for, foreach, while, unless, &&, ||", "if, for, foreach, while, unless", "&& ||", ("sub ",), "elsif", comment="#"),
    "Erlang": _of("if, case, receive", "if, case, receive", "", (), "", "", braces=False, comment="%"),
    **dict.fromkeys(("OCaml", "F#"), _OCAML),
    "R": _of("else if, if, for, while, repeat, &&, ||", "if, for, while, repeat", "&& ||", comment="#"),
    "Julia": _of("elseif, if, for, while, &&, ||", "if, for, while", "&& ||", ("function ",), "elseif", braces=False, comment="#"),
    "Nim": _of("elif, if, for, while, case, except", "if, for, while, case, except", "", ("proc ", "func "), "elif", braces=False, comment="#"),
    "Zig": _of("else, if, for, while, switch", "if, for, while, switch", "", ("fn ",), ""),
    "Clojure": _of("if, cond, case, when", "if, cond, case, when", "", ("defn ",), "", "", braces=False, comment=";"),
    "Kaikai": _of("if, match, case, when, handle, with, and, or", "if, match, case, when, handle", "and or", ("fn ",), "", comment="#"),
}
#: First words of lines that are no C-like function, and bounds of the levels.
CONTROL = ("if", "for", "while", "switch", "else", "do", "catch", "return", "case")
CYCLOMATIC_LEVELS = [(5, "simple"), (10, "moderate"), (20, "complex"), (50, "highly_complex")]
COGNITIVE_LEVELS = [(4, "simple"), (9, "moderate"), (14, "complex"), (24, "highly_complex")]

#: Symbols that all languages but the shell and Kaikai have.
_BASE = "== != <= >= += -= *= /= %= + - * / % < > = ; , . : ( ) [ ] { }"


def _tokens(keywords: str, symbols: str, ignored: str, base: str = _BASE) -> Tokens:
    both = f"{base} {symbols}".split()
    return Tokens(tuple(keywords.split()), tuple(sorted(both, key=lambda s: -len(s))), tuple(ignored.split()))


_C_TOKENS = _tokens(
    "if else for while do switch case default return break continue goto sizeof new delete throw try catch",
    "-> :: && || &= |= ^= <<= >>= << >> ++ -- & | ^ ~ ! ? #",
    "typedef struct union enum class namespace using template virtual override int long short char float double void unsigned signed bool auto const static extern register volatile inline public private protected",
)
_JS_TOKENS = _tokens(
    "if else for while do switch case default return break continue throw try catch finally new delete typeof instanceof in of yield",
    "=== !== >>> **= >>= <<= => && || ?? &= |= ^= ** << >> ++ -- & | ^ ~ ! ?",
    "function var let const class extends import export async await undefined void",
)
_SHELL_TOKENS = _tokens(
    "if then elif else fi for while until do done case esac in return exit break continue",
    "&& || == != <= >= >> << ;; | & ; < > = ( ) [ ] { } ! $",
    "function local export readonly declare eval exec source",
    base="",
)
#: Tokens by language.
TOKENS = {
    "Rust": _tokens(
        "if else match for while loop return break continue as in",
        "..= ... => -> && || &= |= ^= <<= >>= << >> :: .. & | ^ ! ? #",
        "fn let mut const static extern unsafe async await move ref impl struct enum trait type use mod where pub crate super self Self dyn i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Option Result Box",
    ),
    "Python": _tokens(
        "if elif else for while return yield try except finally raise assert del break continue in not and or is with",
        "**= //= >>= <<= ** // &= |= ^= << >> -> & | ^ ~ @",
        "def class import from as lambda global nonlocal async await pass int float str bool list dict tuple set type",
    ),
    **dict.fromkeys(("JavaScript", "TypeScript"), _JS_TOKENS),
    "Go": _tokens(
        "if else for switch case default return break continue go defer select range",
        ":= && || &= |= ^= <<= >>= << >> <- ++ -- & | ^ !",
        "func var const type struct interface import package map chan int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 bool string byte rune error",
    ),
    **dict.fromkeys(("C", "C++", "C#", "Java", "Objective-C", "PHP", "Dart"), _C_TOKENS),
    "Ruby": _tokens(
        "if elsif else unless case when while until for do begin rescue ensure raise return break next yield end then in and or not",
        "<=> === **= &&= ||= => && || ** << >> .. & | ^ ~ ! ? @",
        "def class module require include extend attr_reader attr_writer attr_accessor",
    ),
    "Kotlin": _tokens(
        "if else when for while do return break continue throw try catch finally is as in",
        "?: && || -> :: ++ -- .. ! ? @",
        "fun val var class object interface import package private public protected internal open override abstract data sealed companion Int Long Short Byte Float Double Boolean Char String Unit Any Nothing",
    ),
    "Swift": _tokens(
        "if else guard switch case default for while repeat return break continue throw try catch as is in",
        "&& || -> ..< ... ?? & | ^ ~ ! ? @",
        "func let var class struct enum protocol extension import where private public internal open fileprivate override mutating static Int Float Double Bool String Character Void Any Self",
    ),
    **dict.fromkeys(("Bourne Shell", "Bourne Again Shell", "Zsh"), _SHELL_TOKENS),
    "Kaikai": _tokens(
        "if else match case when handle with and or not as",
        "|> |? ... ++ == != <= >= := => -> || .. + - * / % ^ | ! < > = ; , . : ( ) [ ] { } @ ?",
        "fn let var const type effect protocol impl import use pub priv extern test bench axiom check where requires ensures assert unit true false Int Real Bool String Char Unit",
        base="",
    ),
}
