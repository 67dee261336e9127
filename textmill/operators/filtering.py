"""The filter pipeline: scores, verdicts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions.quality import Score, default_scores
from textmill.runtime import spread


def evaluate(df: DataFrame, text_col: str = "text", scores: list[Score] | None = None) -> DataFrame:
    """``df`` with ``score_<name>`` for each score, ``failed_filters`` and ``passed``.

    All scores are computed, whether others fail or not; failures are in the
    order of the scores. Columns of these names are replaced. A null text has
    null scores, fails as ``null_text`` and never passes. An empty list of
    scores means the default ones.
    """
    scores = scores or default_scores()
    names = [s.name for s in scores]
    if len(set(names)) < len(names):
        raise ValueError("scores need different names")
    scored = spread(df).withColumns({f"score_{s.name}": F.when(F.col(text_col).isNotNull(), s.build(F.col(text_col))) for s in scores})
    failed = F.array_compact(F.array(*[F.when(F.col(f"score_{s.name}") < s.threshold, F.lit(s.name)) for s in scores]))
    verdict = F.when(F.col(text_col).isNull(), F.array(F.lit("null_text"))).otherwise(failed)
    return scored.withColumn("failed_filters", verdict).withColumn("passed", F.size("failed_filters") == 0)


def results(evaluated: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """Decision log: sample, map of scores, verdict."""
    scores = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"score_{n}") for n in names]))
    return evaluated.select(F.col(id_col), F.col(text_col).alias("sample"), scores.alias("scores"), "passed", "failed_filters")


def stats(evaluated: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """One pass over the verdicts: counts, rejections by filter, mean scores.

    A text that fails k filters counts with each of them. Rates over no rows
    are 0. With ``by``, one row a group.
    """
    rate = F.coalesce(F.sum(F.col("passed").cast("int")) / F.count(F.lit(1)), F.lit(0.0))
    aggs: list[Column] = [F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).cast("long").alias("passed"), rate.alias("pass_rate")]
    for n in names:
        aggs.append(F.coalesce(F.sum(F.array_contains("failed_filters", n).cast("int")), F.lit(0)).cast("long").alias(f"rejected_{n}"))
        aggs.append(F.avg(f"score_{n}").alias(f"mean_{n}"))
    return evaluated.groupBy(*(by or [])).agg(*aggs).withColumn("failed", F.col("total") - F.col("passed"))


def filter_samples(df: DataFrame, text_col: str = "text", scores: list[Score] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, as they came, and the statistics of all rows."""
    scores = scores or default_scores()
    done = evaluate(df, text_col, scores)
    return done.where("passed").select(*df.columns), stats(done, [s.name for s in scores])


def hard_length(df: DataFrame, text_col: str = "text", min_len: int = 1, max_len: int | None = None, count_words: bool = False) -> DataFrame:
    """Rows whose length is within the limits; null texts are out."""
    n = F.size(tx.words(F.col(text_col))) if count_words else F.length(text_col)
    return df.where((n >= min_len) & (F.lit(True) if max_len is None else n <= max_len) & F.col(text_col).isNotNull())
