"""Mixing sources to target weights: capped water-filling and seeded sampling.

A source takes part with the tokens of its documents. Its amount is its weight
times a common level, but no more than ``max_repeats`` passes over it; what
that cuts off raises the level of the others until the budget is met or every
source is at its limit. Whole passes take every document, the fraction that is
left takes documents in the order of a seeded hash as long as they fit.

The order is never sorted as a whole: a histogram over SLICES ranges of the
hash shows the range in which the fraction ends, ranges before it are taken
whole, and only that one is ordered, a few thousandths of a source. Tokens are
counted once, in a narrow stage, and written; texts are not shuffled.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.runtime import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text into pieces that belongs to the vocabulary. A fixed value.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICES = 4096
#: Mixtures are plans of this size at most; they are computed on the driver.
MOST_TARGETS = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def source_name(c: Column) -> Column:
    """Sources differ neither by case nor by outer white space."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.lower(F.when(trimmed != "", trimmed))


def count_tokens(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without its text and with ``tokens``, as a written table."""
    kept = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for pdf in batches:
            yield pdf[kept].assign(tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in pdf[text_col]])

    return materialize(spread(df).mapInPandas(run, f"{schema}, tokens long"), "tokens")


def water_fill(weights: dict[str, float], limits: dict[str, float], budget: float) -> dict[str, float]:
    """Amounts in proportion to weights, none above its limit, budget in all."""
    amounts = {k: 0.0 for k in weights}
    open_ = {k for k, w in weights.items() if w > 0 and limits[k] > 0}
    left = budget
    while open_ and left > 0:
        level = left / sum(weights[k] for k in open_)
        clamped = {k for k in open_ if weights[k] * level >= limits[k]}
        if not clamped:
            for k in open_:
                amounts[k] = weights[k] * level
            return amounts
        for k in clamped:
            amounts[k] = limits[k]
            left -= limits[k]
        open_ -= clamped
    return amounts


def _allotments(counted: DataFrame, targets: DataFrame) -> list[tuple]:
    """One row a mixture and source: what it has, gets and would have had."""
    goals = targets.select("mixture_id", source_name(F.col("source")).alias("source"), "weight", "max_repeats", "budget_ratio").where("mixture_id is not null and source is not null")
    goals = goals.groupBy("mixture_id", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("size"))
    rows = goals.join(sizes, "source", "left").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} rows of mixtures")
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r["mixture_id"]].append(r)
    out = []
    for name, own in sorted(by.items()):
        weights = {r["source"]: max(0.0, r["weight"] or 0.0) for r in own}
        sizes_ = {r["source"]: int(r["size"] or 0) for r in own}
        limits = {r["source"]: max(0.0, r["max_repeats"] or 0.0) * sizes_[r["source"]] for r in own}
        budget = max((r["budget_ratio"] or 0.0) for r in own) * sum(sizes_.values())
        amounts = water_fill(weights, limits, budget)
        total = sum(weights.values()) or 1.0
        for s in sorted(weights):
            size = sizes_[s]
            passes = amounts[s] / size if size else 0.0
            whole = int(passes + 1e-9)
            part = max(0.0, amounts[s] - whole * size)
            out.append((name, s, weights[s] / total, size, limits[s], budget, amounts[s], whole, int(part + 1e-6)))
    return out


_PLAN = "mixture_id string, source string, target_share double, size long, limit double, budget double, amount double, whole long, part long"


def _prepared(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    named = documents.select(F.col(doc_id).alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).where("source is not null and text is not null and text <> ''")
    counted = count_tokens(named, "text", tokenizer)
    plan = documents.sparkSession.createDataFrame(_allotments(counted, targets), _PLAN)
    return counted, plan


def _drawn(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col("mixture_id"), F.col("id"))
    share = counted.where("tokens > 0").join(plan.where("amount > 0").select("mixture_id", "source", "whole", "part"), "source")
    share = share.withColumn("order", order).withColumn("slice", F.shiftrightunsigned("order", 52).cast("int"))
    sliced = share.groupBy("mixture_id", "source", "part", "slice").agg(F.sum("tokens").alias("n"))
    run = Window.partitionBy("mixture_id", "source").orderBy("slice")  # at most SLICES rows a source
    ends = sliced.withColumn("upto", F.sum("n").over(run)).where("upto > part").groupBy("mixture_id", "source").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("n")).alias("before")), "slice").alias("end")).select("mixture_id", "source", F.col("end.slice").alias("end"), F.col("end.before").alias("before"))
    placed = share.join(ends, ["mixture_id", "source"], "left").withColumn("end", F.coalesce("end", F.lit(SLICES)))
    cols = ["mixture_id", "source", "id", "tokens", "whole"]
    inside = placed.where("slice < end").select(*cols, F.lit(1).alias("extra"))
    beyond = placed.where("slice > end and whole > 0").select(*cols, F.lit(0).alias("extra"))
    fine = Window.partitionBy("mixture_id", "source").orderBy("order", "id")
    edge = placed.where("slice = end").withColumn("upto", F.col("before") + F.sum("tokens").over(fine)).select(*cols, F.when(F.col("upto") <= F.col("part"), 1).otherwise(0).alias("extra"))
    return inside.union(beyond).union(edge).withColumn("repeats", F.col("whole") + F.col("extra")).where("repeats > 0").select("mixture_id", "source", "id", "tokens", "repeats")


def mix_sources(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(mixture_id, source, doc_id, tokens, repeats)``: the documents drawn.

    ``targets`` has ``mixture_id, source, weight, max_repeats, budget_ratio``;
    the budget is that share of the tokens of all documents of the mixture's
    sources. ``repeats`` says how often the document is used; documents not
    drawn have no row. Documents with null or blank source, or without text,
    belong to no source. Null weights, limits or ratios count as zero. Equal
    seeds give equal draws on any number of partitions. Without documents or
    targets the result is empty.
    """
    counted, plan = _prepared(documents, targets, doc_id, text, source, tokenizer)
    return _drawn(counted, plan, seed).withColumnRenamed("id", doc_id)


def mixture_report(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, tokenizer: str = TOKENIZER) -> DataFrame:
    """What each source of each mixture has, should give and gives.

    ``share`` is of the tokens drawn; ``limited`` marks sources at their
    limit, sources without documents among them.
    """
    counted, plan = _prepared(documents, targets, doc_id, text, source, tokenizer)
    got = _drawn(counted, plan, seed).groupBy("mixture_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("documents"))
    every = plan.join(got, ["mixture_id", "source"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    total = F.sum("drawn").over(Window.partitionBy("mixture_id"))
    return every.select(
        "mixture_id", "source", "target_share", (F.col("drawn") / F.when(total > 0, total)).alias("share"), "size", "drawn", F.round("budget").cast("long").alias("budget"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.col("drawn") / F.when(F.col("size") > 0, F.col("size"))).alias("passes"), (F.col("amount") >= F.col("limit")).alias("limited"),
    )
