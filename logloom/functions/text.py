"""Small text helpers, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (Unicode White_Space).
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression character class body.
WHITESPACE_CLASS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _may_be_blank(char: Column) -> Column:
    """Cheap screen for one character (or none): printable ASCII is never white space."""
    return ~char.between("!", "~")


def strip(col: Column) -> Column:
    """Trim both ends. Trimming by a set is slow, so most texts only have their ends looked at."""
    ends = _may_be_blank(F.substring(col, 1, 1)) | _may_be_blank(F.substring(col, -1, 1))
    return F.when(ends, F.trim(col, F.lit(WHITESPACE))).otherwise(col)


def strip_left(col: Column) -> Column:
    return F.when(_may_be_blank(F.substring(col, 1, 1)), F.ltrim(col, F.lit(WHITESPACE))).otherwise(col)


def is_blank(col: Column) -> Column:
    return _may_be_blank(F.substring(col, 1, 1)) & (F.ltrim(col, F.lit(WHITESPACE)) == "")


def is_indented(col: Column) -> Column:
    """True when the text starts with white space."""
    return _may_be_blank(F.substring(col, 1, 1)) & (F.ltrim(col, F.lit(WHITESPACE)) != col)


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def fold(col: Column) -> Column:
    """Case-folded form used for every case-insensitive comparison."""
    return F.lower(col)


def contains_ignore_case(col: Column, needle: str) -> Column:
    return F.contains(fold(col), F.lit(needle.lower()))


def shorten(col: Column, limit: int) -> Column:
    """Texts longer than ``limit`` become their first ``limit - 1`` characters and ``...``."""
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.left(col, F.lit(max(0, limit - 1))), F.lit("..."))
    )
