"""A1 notation and small text functions as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters(number) -> Column:
    """1 -> A, 27 -> AA, 16384 -> XFD; three letters at most, as sheets have them."""
    n = _col(number).cast("int")
    digit = lambda x: F.chr((F.pmod(x - 1, F.lit(26)) + 65).cast("long"))
    tens, hundreds = F.floor((n - 1) / 26).cast("int"), F.floor((n - 27) / 676).cast("int")
    return F.concat(F.when(n > 702, digit(hundreds)).otherwise(""), F.when(n > 26, digit(tens)).otherwise(""), digit(n))


@lru_cache(1 << 15)
def letters_of(n: int) -> str:
    """As letters, of a Python number."""
    out = ""
    while n:
        n, digit = divmod(n - 1, 26)
        out = chr(65 + digit) + out
    return out


def number(text) -> Column:
    """A -> 1, XFD -> 16384."""
    return F.aggregate(F.filter(F.split(F.upper(_col(text)), ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def coord(row, col) -> Column:
    return F.concat(letters(col), _col(row).cast("string"))


def rect(r1, c1, r2, c2) -> Column:
    """A single cell has no colon."""
    first, last = coord(r1, c1), coord(r2, c2)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(":"), last))


def parse(ref) -> Column:
    """A1, $A$1 or A1:B2 to a struct r1, c1, r2, c2; null where it isn't a reference."""
    clean = F.upper(F.regexp_replace(_col(ref), r"\$", ""))
    pattern = r"^([A-Z]{1,3})([0-9]{1,7})(?::([A-Z]{1,3})([0-9]{1,7}))?$"
    part = lambda k: F.regexp_extract(clean, pattern, k)
    r1, c1 = part(2).try_cast("int"), number(part(1))
    both = part(3) != ""
    return F.when(clean.rlike(pattern), F.struct(r1.alias("r1"), c1.alias("c1"), F.when(both, part(4).try_cast("int")).otherwise(r1).alias("r2"), F.when(both, number(part(3))).otherwise(c1).alias("c2")))


def inside(row, col, r1, c1, r2, c2) -> Column:
    return _col(row).between(_col(r1), _col(r2)) & _col(col).between(_col(c1), _col(c2))


def overlap(a: str, b: str) -> Column:
    """Whether the rectangles in the columns of prefixes a and b share a cell."""
    x = lambda p, n: F.col(f"{p}{n}")
    return ~((x(a, "r2") < x(b, "r1")) | (x(a, "r1") > x(b, "r2")) | (x(a, "c2") < x(b, "c1")) | (x(a, "c1") > x(b, "c2")))


def identity(*parts) -> Column:
    """Stable id of some columns."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]))


def normal(text) -> Column:
    """Lower case, without white space at both ends."""
    return F.lower(F.regexp_replace(_col(text), r"^\s+|\s+$", ""))


def html_escape(text) -> Column:
    out = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def pad(text, width) -> Column:
    """Blanks on the right up to the width; longer texts stay whole."""
    t = _col(text)
    return F.concat(t, F.repeat(F.lit(" "), F.greatest(F.lit(0), _col(width) - F.length(t)).cast("int")))


def tokens(text) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.expr("1"), F.floor(F.length(_col(text)) / 4)).cast("long")
