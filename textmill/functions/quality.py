"""Quality scores in [0, 1] as column expressions, one builder each.

All but the entropy are built-in expressions. Entropy counts characters: as a
relational plan that is a row for each character and a shuffle, so it is an
Arrow function over the batch instead, which keeps the stage narrow.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions import text as tx

# Words that speak for a language, and what a link looks like.
COMMON_WORDS = {
    "en": "the be to of and a in that have i it for not on with is was are as".split(),
    "code": "def class import return if else for while function const let var fn pub impl".split(),
}
LINK = rf"https?://[^{tx.SPACE}]+|www\.[^{tx.SPACE}]+"
SHORT_TEXT = 10


@dataclass(frozen=True)
class Score:
    """A named score with the threshold a text has to reach."""

    name: str
    build: Callable[[Column], Column]
    threshold: float = 0.5


def length(min_len: int = 1, max_len: int = 100_000, count_words: bool = False, threshold: float = 0.5, name: str = "length") -> Score:
    """Soft limits: short and long texts lose in proportion."""

    def build(c: Column) -> Column:
        n = (F.size(tx.words(c)) if count_words else F.length(c)).cast("double")
        short = n / min_len if min_len > 0 else F.lit(0.0)
        return F.when(n < min_len, short).when(n > max_len, F.lit(float(max_len)) / n).otherwise(1.0)

    return Score(name, build, threshold)


def repetition(threshold: float = 0.7, name: str = "repetition") -> Score:
    """The least share of distinct words, character runs or 2- to 4-grams."""

    def build(c: Column) -> Column:
        runs = F.when(F.length(c) > 1, F.length(F.regexp_replace(c, r"(?s)(.)\1+", "$1")) / F.length(c))

        def of_words(ws: Column) -> Column:
            shares = [F.when(F.size(ws) > 1, tx.distinct_share(ws))]
            shares += [F.when(F.size(ws) >= n, tx.distinct_share(tx.ngrams(ws, n))) for n in (2, 3, 4)]
            return F.least(*shares)

        return F.when(F.length(c) == 0, 0.0).otherwise(F.coalesce(F.least(runs, tx.let(tx.words(c), of_words)), F.lit(1.0)))

    return Score(name, build, threshold)


def char_distribution(threshold: float = 0.6, name: str = "char_distribution") -> Score:
    """The least of the shares of printable, of ordinary and of non-null characters."""

    def build(c: Column) -> Column:
        n = F.length(c).cast("double")
        count = lambda cls: n - F.length(F.regexp_replace(c, cls, ""))
        odd = count(r"[\p{C}\p{Z}]") - count(r"[ \n\t\r]")
        plain = count(rf"[\p{{L}}\p{{N}}{tx.SPACE}]")
        return F.when(n == 0, 0.0).otherwise(F.least((n - odd) / n, plain / n * 1.5, F.lit(1.0) - count(r"\x00") / n))

    return Score(name, build, threshold)


def language(allow: list[str] | None = None, threshold: float = 0.3, name: str = "language") -> Score:
    """Distinct frequent words of the likeliest allowed language, of five."""
    lists = [COMMON_WORDS[k] for k in (allow or list(COMMON_WORDS)) if k in COMMON_WORDS]

    def build(c: Column) -> Column:
        def best(seen: Column) -> Column:
            hits = [F.least(F.lit(1.0), F.size(F.array_intersect(seen, F.array(*map(F.lit, ws)))) / 5.0) for ws in lists]
            return F.greatest(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(0.0)

        return tx.let(F.array_distinct(tx.words(F.lower(c))), best)

    return Score(name, build, threshold)


def entropy(c: Column) -> Column:
    """Bits a character: lower-cased characters over the length as given."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            if t is None:
                return None
            n = len(t)
            return -sum(k / n * math.log2(k / n) for k in Counter(t.lower()).values()) if n else 0.0

        return batch.map(one)

    return run(c)


def perplexity(max_entropy: float = 5.0, threshold: float = 0.5, name: str = "perplexity") -> Score:
    """Character entropy as a stand-in for perplexity."""

    def build(c: Column) -> Column:
        h = entropy(c)
        return F.when(F.length(c) < SHORT_TEXT, 0.5).when(h < 1.0, 0.3).when(h > max_entropy, F.greatest(F.lit(0.0), 1 - (h - max_entropy) / max_entropy)).otherwise(1.0)

    return Score(name, build, threshold)


def url_density(max_url_ratio: float = 0.3, threshold: float = 0.5, name: str = "url_density") -> Score:
    """The share of a text inside links, beyond what is allowed."""

    def build(c: Column) -> Column:
        inside = F.aggregate(F.regexp_extract_all(c, F.lit(LINK), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
        ratio = inside / F.length(c)
        beyond = (ratio - max_url_ratio) / (1 - max_url_ratio) if max_url_ratio < 1 else F.lit(0.0)
        return F.when(F.length(c) == 0, 1.0).when(ratio <= max_url_ratio, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - beyond))

    return Score(name, build, threshold)


def default_scores() -> list[Score]:
    return [length(50, 100_000), repetition(), char_distribution(), language(), perplexity(), url_density()]
