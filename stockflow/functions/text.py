"""Codes, names and other text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Every character that counts as white space at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the word that marks a defective copy of an item.
DEFECT_MARKERS = ("дефект",)

# Fixed value: how a missing part of an item key is written.
MISSING_TEXT = "nan"


def as_col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip_ws(column: Column | str) -> Column:
    """Text form without leading and trailing white space of any kind."""
    return F.btrim(as_col(column).cast("string"), F.lit(WHITESPACE))


def norm_code(column: Column | str, drop: str = "- _") -> Column:
    """Item code without separators, in upper case."""
    return F.upper(F.translate(as_col(column), drop, ""))


def norm_name(column: Column | str, markers: Iterable[str] = DEFECT_MARKERS) -> Column:
    """Item name in lower case, without defect markers and outer white space."""
    name = F.lower(as_col(column))
    for marker in markers:
        name = F.replace(name, F.lit(marker), F.lit(""))
    return strip_ws(name)


def item_key(code: Column | str, name: Column | str) -> Column:
    """Code and name joined by a bar."""
    missing = F.lit(MISSING_TEXT)
    return F.concat(
        F.coalesce(as_col(code).cast("string"), missing),
        F.lit("|"),
        F.coalesce(as_col(name).cast("string"), missing),
    )


def name_changed(name: Column | str, canonical: Column | str) -> Column:
    """True where the name is not the canonical one; a missing name counts as changed."""
    return F.coalesce(as_col(name) != as_col(canonical), F.lit(True))
