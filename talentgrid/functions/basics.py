"""Small column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, functions as F

CJK = "[一-龥]"


def sql_str(text: str) -> str:
    """``text`` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def alternation(words: Iterable[str]) -> str:
    """Regex alternation, longest word first so that a prefix never shadows."""
    def quote(w: str) -> str:
        return "".join("\\" + ch if ch in r".^$*+?{}[]\|()-" else ch for ch in w)
    return "|".join(quote(w) for w in sorted(words, key=len, reverse=True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    The value is bound as the variable of a one-element transform.  A plain
    column alias would be inlined again, and inside a lambda even per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def strip_ws(c: Column) -> Column:
    """Trim every Unicode blank, as ``str.strip`` does (``trim`` knows spaces only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def blank_to_null(c: Column) -> Column:
    """NULL for ``''``: the empty string counts as missing everywhere."""
    return F.when(c != "", c)


def non_empty(c: Column) -> Column:
    """Not NULL and not ``''``."""
    return c.isNotNull() & (c != "")


def truthy(c: Column) -> Column:
    """Not NULL and not 0."""
    return F.coalesce(c != 0, F.lit(False))


def strip_or_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return blank_to_null(strip_ws(c))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match, NULL (not ``''``) without one."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return c.rlike(alternation(words))


def ends_with_any(c: Column, words: Iterable[str]) -> Column:
    return c.rlike(f"(?:{alternation(words)})\\z")
