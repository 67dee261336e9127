"""Preference pairs: making, checking, scoring them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx


def word_reward(response: Column) -> Column:
    """The reward where none is given: the number of words."""
    return F.size(tx.words(response)).cast("double")


def best_of_n(samples: DataFrame, prompt_cols: list[str], index_col: str, response_col: str, reward: Column) -> DataFrame:
    """One pair a prompt: the first of the best and the last of the worst.

    A single sample is both. Null responses or rewards take no part. Maxima are
    combined before the shuffle, so a prompt may have any number of samples.
    """
    best = F.max(F.struct(F.col("_r"), (-F.col(index_col)).alias("i"), F.col(response_col).alias("t")))
    worst = F.min(F.struct(F.col("_r"), (-F.col(index_col)).alias("i"), F.col(response_col).alias("t")))
    rated = samples.withColumn("_r", reward.cast("double")).where(F.col("_r").isNotNull() & F.col(response_col).isNotNull())
    return rated.groupBy(*prompt_cols).agg(best.alias("b"), worst.alias("w")).select(
        *prompt_cols, F.col("b.t").alias("chosen"), F.col("w.t").alias("rejected"), F.col("b._r").alias("chosen_score"), F.col("w._r").alias("rejected_score")
    )


def pairs_of_two(a: Column, b: Column, reward_a: Column | None = None, reward_b: Column | None = None, prefer: str = "a") -> Column:
    """Struct (chosen, rejected, chosen_score, rejected_score) of two responses; a wins ties."""
    def pair(x: Column, y: Column, s: Column, t: Column) -> Column:
        return F.struct(x.alias("chosen"), y.alias("rejected"), s.alias("chosen_score"), t.alias("rejected_score"))

    if reward_a is None or reward_b is None:
        zero = F.lit(0.0)
        return pair(a, b, zero, zero) if prefer == "a" else pair(b, a, zero, zero)
    return F.when(reward_a >= reward_b, pair(a, b, reward_a, reward_b)).otherwise(pair(b, a, reward_b, reward_a))


def format_pair(prompt: Column, chosen: Column, rejected: Column, metadata: Column | None = None) -> Column:
    """Struct of the pair; empty metadata is null and not written."""
    parts = [prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected")]
    if metadata is not None:
        parts.append(F.when(F.size(metadata) > 0, metadata).alias("metadata"))
    return F.struct(*parts)


def all_valid(df: DataFrame, cols: tuple[str, ...] = ("prompt", "chosen", "rejected")) -> DataFrame:
    """One row: has every pair all its texts? Empty texts are texts; no pairs are valid."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("valid"), F.count(F.lit(1)).alias("pairs"), F.count_if(~ok).alias("invalid"))


def complete(df: DataFrame, cols: tuple[str, ...] = ("prompt", "chosen", "rejected")) -> DataFrame:
    """Pairs whose texts are all there and not empty."""
    for c in cols:
        df = df.where(F.length(c) > 0)
    return df


def preference_accuracy(df: DataFrame, score: Column, by: list[str] | None = None) -> DataFrame:
    """Share of pairs scored above zero (ties are wrong) and the mean score; 0 over none."""
    s = score.cast("double")
    return df.groupBy(*(by or [])).agg(
        F.coalesce(F.sum((s > 0).cast("int")), F.lit(0)).cast("long").alias("correct"), F.count(s).alias("total"),
        F.coalesce(F.avg((s > 0).cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_score"),
    )


def generate(df: DataFrame, id_col: str, prompt_col: str, make_generator: Callable[[], Callable[[list[str]], list[str]]], out_col: str = "response") -> DataFrame:
    """``df`` keys with generated text: a model runs once a worker, on batches."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_generator()
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], out_col: model(pdf["_prompt"].tolist())})

    return df.select(id_col, F.col(prompt_col).alias("_prompt")).mapInPandas(run, f"`{id_col}` {kind}, `{out_col}` string")


# Prompts of critique and revision.
def critique_prompt(response: Column, principle: Column) -> Column:
    return F.concat(F.lit("Response: "), response, F.lit("\n\nCritique this response based on: "), principle, F.lit("\n\nCritique:"))


def revision_prompt(response: Column, critique: Column) -> Column:
    return F.concat(F.lit("Original response: "), response, F.lit("\n\nCritique: "), critique, F.lit("\n\nRevised response following the critique:"))


def pick(options: list[str], key: Column, seed: int = 0) -> Column:
    """A choice of the options that depends on key and seed alone."""
    n = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, options)), F.pmod(n, F.lit(len(options))).cast("int"))


def constitution_pairs(df: DataFrame, id_col: str, prompt_col: str, principles: list[str], make_generator, seed: int = 0) -> DataFrame:
    """``(id, prompt, chosen, rejected)``: the revised response is chosen, the first one rejected."""
    base = df.select(id_col, F.col(prompt_col).alias("prompt"))
    first = base.join(generate(base, id_col, "prompt", make_generator, "rejected"), id_col)
    asked = first.withColumn("ask", critique_prompt(F.col("rejected"), pick(principles, F.col(id_col), seed)))
    judged = asked.drop("ask").join(generate(asked, id_col, "ask", make_generator, "critique"), id_col)
    again = judged.withColumn("ask", revision_prompt(F.col("rejected"), F.col("critique")))
    return again.drop("ask", "critique").join(generate(again, id_col, "ask", make_generator, "chosen"), id_col).select(id_col, "prompt", "chosen", "rejected")
