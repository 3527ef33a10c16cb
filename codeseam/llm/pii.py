"""Format-preserving pseudonyms for validated numbers, dates and addresses, in SQL functions only.

Every value is permuted within its own format by a keyed Feistel network, so equal values get
equal pseudonyms in all documents and different values different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 4
#: Candidates, in the order in which they are tried at a place.
PATTERNS = {
    # a domain name has at most 127 labels
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    # with +1, with the area in brackets, or with separators
    "phone": r"(?:(?<![0-9])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?|(?<![0-9A-Za-z+]|[0-9][.-])(?:1[ .-]?\([0-9]{3}\)[ .-]?|(?:1[ .-])?[0-9]{3}[ .-])[0-9]{3}[ .-]|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-])[0-9]{4}(?![0-9])",
    # alone or before the time of a timestamp
    "date": r"(?<![0-9A-Za-z.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=[Tt][0-9]{2})|(?![0-9A-Za-z-]))",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    # without gaps, or in groups of 4-4-4-4, 4-6-5 or 4-6-4 digits
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5})(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: A cheap test that every candidate passes.
HINT = r"[0-9][0-9. -]{6}|@"
#: Dates of this whole Gregorian cycle are permuted among themselves: 146097 = 189 * 773 days.
FIRST_DAY, DAYS, LEFT_DAYS = "1800-01-01", 146_097, 189


def noise(key: str, tweak: Column | str, round_: int, value: Column) -> Column:
    """60 keyed pseudo-random bits of a value."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit(str(round_)), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column | str) -> tuple[Column, Column]:
    """A permutation of the pairs left < left_size, right < right_size (whole numbers): the halves
    in turn are shifted by keyed noise of the other."""
    for k in range(ROUNDS):
        if k % 2:
            right = (right + noise(key, tweak, k, left)) % right_size
        else:
            left = (left + noise(key, tweak, k, right)) % left_size
    return left, right


def with_value(x: Column, f) -> Column:
    """f(x) with x computed once: a lambda over a one-element array."""
    return F.element_at(F.transform(F.array(x), f), 1)


def digits_permuted(s: Column, key: str, tweak: str) -> Column:
    """Another digit string of the same length (1 to 30)."""
    n = F.char_length(s)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left = F.when(half > 0, F.substr(s, F.lit(1), half)).otherwise("0").cast("long")
    right = F.substr(s, half + 1, n - half).cast("long")
    a, b = feistel(left, right, ten(half), ten(n - half), key, F.concat(F.lit(tweak), n.cast("string")))
    return F.concat(F.when(half > 0, F.lpad(a.cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(b.cast("string"), n - half, F.lit("0")))


def luhn_sum(s: Column, check: int) -> Column:
    """The Luhn sum of a digit string; check: 1 if its last digit is the check digit, else 0."""
    n = F.char_length(s)
    digit = lambda i: F.substr(s, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == check, doubled(digit(i))).otherwise(digit(i)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refilled(s: Column, digits: Column) -> Column:
    """s with its digits replaced, in turn, by those given; all else stays."""
    at = lambda i: F.char_length(digits_of(F.substr(s, F.lit(1), i)))
    one = lambda i: F.when(F.substr(s, i, F.lit(1)).between("0", "9"), F.substr(digits, at(i), F.lit(1))).otherwise(F.substr(s, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(s)), one), "")


def card(s: Column, key: str) -> Column:
    """A card number's payload after its first digit is permuted; the check digit follows."""

    def of(d: Column) -> Column:
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), digits_permuted(F.substr(d, F.lit(2), F.char_length(d) - 2), key, "card"))
        return with_value(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string")))

    return with_value(with_value(digits_of(s), of), lambda d: refilled(s, d))


def phone(s: Column, key: str) -> Column:
    """The last ten digits: areas from 200 on keep their 800 values, areas below 200 (none is
    given out, but they are written) their 200, and the seven digits after it theirs."""

    def of(d: Column) -> Column:
        n = F.char_length(d)
        area, rest = F.substr(d, n - 9, F.lit(3)).cast("long"), F.substr(d, n - 6, F.lit(7)).cast("long")
        low = area < 200
        base = F.when(low, 0).otherwise(200)
        a, b = feistel(area - base, rest, F.when(low, 200).otherwise(800), F.lit(10_000_000), key, "phone")
        return F.concat(F.substr(d, F.lit(1), n - 10), F.lpad((a + base).cast("string"), 3, "0"), F.lpad(b.cast("string"), 7, "0"))

    return with_value(with_value(digits_of(s), of), lambda d: refilled(s, d))


def ip(s: Column, key: str) -> Column:
    part = lambda k: F.split_part(s, F.lit("."), F.lit(k)).cast("long")
    a, b = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, "ip")
    return F.concat_ws(".", F.floor(a / 256).cast("string"), (a % 256).cast("string"), F.floor(b / 256).cast("string"), (b % 256).cast("string"))


def date(s: Column, key: str) -> Column:
    day = F.date_diff(F.to_date(s), F.to_date(F.lit(FIRST_DAY))).cast("long")
    a, b = feistel(day % LEFT_DAYS, F.floor(day / LEFT_DAYS), F.lit(LEFT_DAYS), F.lit(DAYS // LEFT_DAYS), key, "date")
    return F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), (b * LEFT_DAYS + a).cast("int")), "yyyy-MM-dd")


def characters_shifted(s: Column, other: Column, key: str, tweak: Column, k: int) -> Column:
    """Letters and digits of s, each shifted within its own kind by keyed noise of `other`."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit(str(k)), other), 512)

    def one(c: Column, i: Column) -> Column:
        shift = F.conv(F.substr(stream, (i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        rolled = lambda first, n: F.chr((code - first + shift + i) % n + first)
        return F.when(code.between(48, 57), rolled(48, 10)).when(code.between(65, 90), rolled(65, 26)).when(code.between(97, 122), rolled(97, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def email(s: Column, key: str) -> Column:
    """The local part keeps its length, dots and kinds of characters; the domain stays."""
    local = F.substring_index(s, "@", 1)
    n = F.char_length(local)
    half = F.floor(n / 2).cast("int")
    halves = F.struct(F.substr(local, F.lit(1), half).alias("a"), F.substr(local, half + 1, n - half).alias("b"))
    tweak = F.concat(F.lit("email"), n.cast("string"))
    for k in range(ROUNDS):
        if k % 2:
            halves = with_value(halves, lambda h, k=k: F.struct(h["a"].alias("a"), characters_shifted(h["b"], h["a"], key, tweak, k).alias("b")))
        else:
            halves = with_value(halves, lambda h, k=k: F.struct(characters_shifted(h["a"], h["b"], key, tweak, k).alias("a"), h["b"].alias("b")))
    return with_value(halves, lambda h: F.concat(h["a"], h["b"], F.lit("@"), F.substring_index(s, "@", -1)))


def kind_of(m: Column) -> Column:
    """The kind of a candidate if it is valid, else null: real dates of 1800 to 2199, octets up to
    255, a correct check digit."""
    whole = lambda k: m.rlike("^(?:" + PATTERNS[k] + ")$")
    octets = F.forall(F.split(m, "\\."), lambda p: p.cast("int") < 256)
    year = F.substr(m, F.lit(1), F.lit(4))
    return (
        F.when(m.contains("@"), "email")
        .when(whole("phone"), "phone")
        .when(whole("date"), F.when(F.try_to_date(m, "yyyy-MM-dd").isNotNull() & year.between("1800", "2199"), "date"))
        .when(whole("ip"), F.when(octets, "ip"))
        .otherwise(F.when(with_value(digits_of(m), lambda d: luhn_sum(d, 1)) % 10 == 0, "card"))
    )


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    """The pseudonym of a valid value; what is no valid value stays."""
    return F.when(kind == "email", email(m, key)).when(kind == "phone", phone(m, key)).when(kind == "date", date(m, key)).when(kind == "ip", ip(m, key)).when(kind == "card", card(m, key)).otherwise(m)


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """docs with the valid values in text replaced by pseudonyms, and one count for each kind.

    Adds n_email, n_phone, n_date, n_ip, n_card and n_values (columns of these names are
    replaced); every other column and row stays. A null text stays null with counts 0, an empty
    one empty; repeated rows are treated alike; an empty table gives no rows. The key is a part of
    the plan: who may see the plan (explain, user interface, event log) sees it.
    """
    if not key:
        raise ValueError("a key is needed")
    f_, k_ = fresh(docs.columns, "found", "kinds")
    added = {f"n_{k}" for k in KINDS} | {"n_values"}
    rest = [c for c in docs.columns if c not in added]
    text = F.col("text")
    found = F.when(text.rlike(HINT) & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    out = docs.select(*rest, found.alias(f_))
    out = out.withColumn(k_, F.transform(f_, kind_of))
    named = F.zip_with(k_, f_, lambda k, m: pseudonym(k, m, key))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), named, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    count = lambda k: F.coalesce(F.size(F.filter(F.col(k_), lambda x: x == k)), F.lit(0)).cast("long")
    counts = {f"n_{k}": F.when(F.col(k_).isNull(), F.lit(0).cast("long")).otherwise(count(k)) for k in KINDS}
    out = out.select(*(F.when(F.col(f_).isNull(), text).otherwise(joined).alias("text") if c == "text" else F.col(c) for c in rest), *(v.alias(n) for n, v in counts.items()))
    return out.withColumn("n_values", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")))
