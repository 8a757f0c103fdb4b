"""String Column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split() sees it: Unicode spaces plus the
# file/group/record/unit separators.
WS = r"(?U)[\s\x1c-\x1f]+"
# The same set as literal characters (for trim without a regex).
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")
_S = r"[\s\x1c-\x1f]"        # one whitespace char (with the (?U) flag)
_N = r"[^\s\x1c-\x1f]"       # one non-whitespace char


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(col) -> Column:
    """``str.split()``: whitespace runs separate, no empty pieces."""
    return F.filter(F.split(_c(col), WS), lambda s: s != F.lit(""))


def word_count(col) -> Column:
    return F.size(words(col)).cast("bigint")


def normalize_ws(col) -> Column:
    """``' '.join(x.split())``."""
    return F.array_join(words(col), " ")


def strip_ws(col) -> Column:
    """``str.strip()`` for whitespace (character-set trim, no regex)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def has_min_words(col, n: int) -> Column:
    """``len(x.split()) >= n`` without splitting the whole text: an anchored
    pattern with possessive quantifiers that stops after the n-th word."""
    if n <= 0:
        return F.lit(True)
    pat = rf"(?U)\A{_S}*+(?:{_N}++{_S}++){{{n - 1}}}{_N}"
    return F.coalesce(_c(col), F.lit("")).rlike(pat)


def leading_words(col, n: int) -> Column:
    """``' '.join(x.split()[:n])``: only the leading n words are scanned."""
    pat = rf"(?U)\A{_S}*+((?:{_N}++(?:{_S}++|\z)){{0,{n}}})"
    return normalize_ws(F.regexp_extract(_c(col), pat, 1))


def strip_chars(col, chars: str) -> Column:
    """``str.strip(chars)`` for a set of literal characters."""
    return F.btrim(_c(col), F.lit(chars))


def count_occurrences(col, sub: str) -> Column:
    """``str.count(sub)`` (non-overlapping, like Python)."""
    c = F.coalesce(_c(col), F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("bigint")


def after_last(col, marker: str) -> Column:
    """``x.split(marker)[-1]``."""
    return F.substring_index(_c(col), marker, -1)
