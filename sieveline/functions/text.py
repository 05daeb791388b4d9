"""Column functions on text: tokens, lines, windows, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that are no identifiers when a query is widened.
KEYWORDS = "public private protected static final class interface extends implements import package if else while for return new this super".split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def code_tokens(text: Column) -> Column:
    """As tokens(), but dots, colons and apostrophes between letters don't split: com.foo.Bar is one token."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+(?:[.':][\p{L}_]+)*"), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def capitalised(text: Column) -> Column:
    """Distinct identifiers of three characters and more that begin with A-Z, in order of first occurrence."""
    return F.array_distinct(F.filter(words(text), lambda w: w.rlike(r"^[A-Z][A-Za-z0-9_]{2,}$")))


def identifiers(text: Column, most: int = 20) -> Column:
    """The first distinct identifiers of three characters and more that are no keywords."""
    plain = F.filter(words(text), lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]{2,}$") & ~F.lower(w).isin(KEYWORDS))
    return F.slice(F.array_distinct(plain), 1, most)


def lines(text: Column) -> Column:
    """Lines without the empty ones at the end."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n+\z", ""), "\n")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 1-based character position."""
    before = F.substring(text, F.lit(1), offset - 1)
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive, clamped), joined."""
    own = lines(text)
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(own, first, F.greatest(F.least(end, F.size(own)) - first + 1, F.lit(0))), "\n")


def window_starts(n: Column, size: int, step: int) -> Column:
    """First lines of the windows over n lines: the last one is the first that reaches the end."""
    more = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.sequence(F.lit(1), 1 + step * more, F.lit(step))


def truncated(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def package_of(name: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)^(.*)\.[^.]*\z", 1)


def attribute(text: Column, name: str) -> Column:
    """First value of an attribute, in either quotes; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"""{name}\s*=\s*["']([^"']*)["']""", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)
