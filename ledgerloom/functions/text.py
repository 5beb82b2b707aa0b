"""Text columns with Python's whitespace, case and Unicode rules."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters Python's str.strip and \s treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a regex class.
WHITESPACE_CLASS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# What is left of it after NFKC, without tab, blank and line ends.
_RARE = r"\x0b\f\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"

# Letters, digits and signs that NFKC leaves alone and that never combine with
# a neighbour. A text made only of these and ASCII needs no normalisation.
NFKC_STABLE = (
    r"\x00-\x9f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0391-\u03a1\u03a3-\u03c9"
    r"\u0400-\u0482\u048a-\u052f"
    r"\u05d0-\u05ea\u0620-\u064a\u0660-\u0669\u06f0-\u06f9"
    r"\u0904-\u0914\u0966-\u096f"
    r"\u2012-\u2016\u2018-\u2023\u2030-\u2032\u20a9-\u20bf"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
)


def strip(column: Column) -> Column:
    """``str.strip``: Spark's trim removes spaces only, so name the set."""
    return F.btrim(column, F.lit(WHITESPACE))


def drop_whitespace(column: Column) -> Column:
    return F.translate(column, WHITESPACE, "")


@F.pandas_udf(StringType())
def _nfkc_values(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(column: Column) -> Column:
    """Unicode NFKC.

    Spark has no such function. Only texts holding a character that could
    change travel to Python; every other row sends a null.
    """
    unstable = F.when(column.rlike(rf"[[^\x00-\x7f]&&[^{NFKC_STABLE}]]"), column)
    return F.coalesce(_nfkc_values(unstable), column)


def compact(column: Column) -> Column:
    """One newline between rows, one blank inside them, nothing around them.

    Equal to normalising line ends, squeezing tabs and blanks, stripping each
    line and dropping the empty ones, but as linear passes over the whole text
    that stay in generated code.
    """
    # A line end with all whitespace behind it.
    text = F.regexp_replace(nfkc(column), rf"[\r\n][\t\r\n {_RARE}]*+", "\n")
    # Runs of tabs and blanks; a single blank is no match and costs nothing.
    text = F.regexp_replace(text, r"\t[\t ]*+| [\t ]++", " ")
    # Whitespace before a line end: runs with rare characters, then the blank
    # that may be left. The look-behind tries a long run once.
    rare_run = rf"[{_RARE}](?<![{_RARE}] ?[{_RARE}])[ {_RARE}]*+\n"
    text = F.replace(F.regexp_replace(text, rare_run, "\n"), F.lit(" \n"), F.lit("\n"))
    return strip(text)


def token_estimate(length: Column) -> Column:
    """Four characters per token, at least one token."""
    return F.greatest(F.lit(1), F.floor((length + 3) / 4).cast("int"))


def _java_class(codepoints: list[int]) -> str:
    """A regex class for code points, written as ranges."""
    parts: list[str] = []
    start = previous = None
    for point in [*codepoints, None]:
        if previous is not None and point == previous + 1:
            previous = point
            continue
        if start is not None:
            parts.append(f"\\x{{{start:x}}}-\\x{{{previous:x}}}")
        start = previous = point
    return "[" + "".join(parts) + "]"


@cache
def _casefold_class() -> str:
    """Characters whose case folding is neither lower case nor handled below."""
    points = []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if char not in "\u00df\u03c2" and char.casefold() != char.lower().replace("\u03c2", "\u03c3"):
            points.append(point)
    return _java_class(points)


@F.pandas_udf(StringType())
def _casefold_values(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def casefold(column: Column) -> Column:
    """Full case folding.

    ``lower`` plus two letters covers nearly every text inside the JVM. The
    rest (ligatures, Cherokee, ...) goes to Python, all other rows as null.
    ``lower(upper(x))`` is no substitute: the optimizer shortens it.
    """
    lowered = F.lower(column)
    simple = F.translate(F.replace(lowered, F.lit("\u00df"), F.lit("ss")), "\u03c2", "\u03c3")
    special = F.when(column.rlike(rf"[[^\x00-\x7f]&&{_casefold_class()}]"), column)
    return F.coalesce(_casefold_values(special), simple)


def fold(column: Column) -> Column:
    """Comparison form of evidence: no whitespace, folded case."""
    return casefold(drop_whitespace(column))


def is_blank(column: Column) -> Column:
    """Null or empty: what Python treats as missing."""
    return F.coalesce(column == "", F.lit(True))


def non_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))
