"""Text semantics as column expressions: words, code points, white space.

White space, words and lengths follow Unicode, not ASCII. The classes are
written out, so that they mean the same in Java's and in RE2's expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class of all white space. A fixed value.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    What a lambda refers to is computed anew for each element it is called on,
    unless it is the variable of another lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Runs without white space, in order; null stays null."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def ngrams(ws: Column, n: int) -> Column:
    """Word n-grams as strings. Words hold no blank, so joining loses nothing.

    ``ws`` should be a column or variable, not an expression: see ``let``.
    """
    count = F.size(ws) - (n - 1)
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    )


def distinct_share(items: Column) -> Column:
    return let(items, lambda x: F.size(F.array_distinct(x)) / F.size(x))
