"""String functions over names and lists of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def underscored(c: str) -> Column:
    return F.regexp_replace(c, " ", "_")


def spaced(c: str) -> Column:
    return F.regexp_replace(c, "_", " ")


def condition_codes(*factors: list[list[int]]) -> str:
    """Codes in all factors (each a union of its levels), sorted and joined by commas."""
    common: set[int] | None = None
    for levels in factors:
        own = {c for level in levels for c in level}
        common = own if common is None else common & own
    return ",".join(str(c) for c in sorted(common or ()))


def mod_from_one(x: Column, n: int) -> Column:
    """Modulo whose values are 1..n."""
    return F.pmod(x - 1, F.lit(n)) + 1


def half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def joined(c: str, delimiter: str = ",") -> Column:
    """An array as text; empty and null elements go."""
    return F.concat_ws(delimiter, F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != "")))


def parted(c: str, delimiter: str = ",") -> Column:
    """A text as an array; delimiters at either end add no empty element."""
    bare = F.regexp_replace(F.regexp_replace(c, f"^{delimiter}", ""), f"{delimiter}$", "")
    return F.split(bare, delimiter)


def longest_common(a: Column, b: Column) -> Column:
    """The longest run of characters that two names share (two at least, else empty; of ties the first in ``a``).

    Names are short: all runs of ``a`` are tried, the longest first.
    """
    n = F.length(a)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i")))
    best = lambda s: F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.lit(0), lambda m, k: F.when((s["i"] + k - 1 <= n) & F.contains(b, F.substring(a, s["i"], k)), k).otherwise(m))
    sized = F.transform(starts, lambda s: F.struct(best(s).alias("k"), (-s["i"]).alias("at")))
    top = F.array_max(sized)
    return F.when(top["k"] >= 2, F.substring(a, -top["at"], top["k"])).otherwise("")


def with_prefix(c: str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c))


def has_all(c: str, patterns: list[str]) -> Column:
    """Does a name contain every one of the patterns?"""
    hit = F.lit(True)
    for p in patterns:
        hit = hit & F.col(c).contains(p)
    return hit
