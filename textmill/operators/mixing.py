"""Sampling schedules over weighted sources of records.

A source gives ``max(1, int(size * weight))`` of its records, the weight being
normalised over the sources: a share of its own size, not of the total. Order
and choice come from an MD5 of seed, source and record, so they are the same on
any number of partitions and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(weights: list[float], sources: int) -> list[float]:
    if not weights or len(weights) != sources:
        raise ValueError("one weight a source is needed")
    if min(weights) <= 0:
        raise ValueError("weights must be positive")
    return [w / sum(weights) for w in weights]


def _key(seed: int, tag: str, ds: Column, idx: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), ds.cast("string"), idx.cast("string")))


def mixture_schedule(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """``(ds_idx, sample_idx, order_key)`` of ``sizes(ds_idx, size, weight)``.

    ``order_key`` puts the schedule in its shuffled order. Each source's
    records are ranked within it in hash ranges, so no source is one task:
    ranges of the key are counted and only the range of the last record taken
    is ordered. Sources without records give none.
    """
    total = sizes.agg(F.sum("weight").alias("_all"))
    want = F.greatest(F.lit(1), F.floor(F.col("size") * F.col("weight") / F.col("_all"))).cast("long")
    plan = sizes.crossJoin(F.broadcast(total)).select("ds_idx", F.when(F.col("size") > 0, want).otherwise(0).alias("take"), F.col("size"))  # one row
    block = 1_000_000
    records = plan.where("size > 0").select("ds_idx", "take", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("b"), "size").select(
        "ds_idx", "take", F.explode(F.sequence(F.col("b") * block, F.least(F.col("size"), (F.col("b") + 1) * block) - 1)).alias("sample_idx")
    )
    return take_least(records.withColumn("key", _key(seed, "s", F.col("ds_idx"), F.col("sample_idx"))), ["ds_idx"], "key", "take").select("ds_idx", "sample_idx", _key(seed, "o", F.col("ds_idx"), F.col("sample_idx")).alias("order_key"))


def take_least(df: DataFrame, group: list[str], key: str, take: str) -> DataFrame:
    """The ``take`` rows of least hex ``key`` in each group, groups of any size.

    The first three digits of a key divide a group into 4096 ranges. Ranges
    before the one where the count is reached are taken whole; only that one is
    ranked.
    """
    cut = df.withColumn("_range", F.substring(key, 1, 3))
    counts = cut.groupBy(*group, take, "_range").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy("_range")  # at most 4096 rows a group
    ends = counts.withColumn("_upto", F.sum("_n").over(run)).withColumn("_before", F.col("_upto") - F.col("_n")).where(F.col("_before") < F.col(take)).select(*group, "_range", "_upto", "_before")
    near = cut.join(ends, [*group, "_range"])
    whole = near.where(F.col("_upto") <= F.col(take)).select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(key))
    part = near.where(F.col("_upto") > F.col(take)).withColumn("_rank", rank + F.col("_before")).where(F.col("_rank") <= F.col(take)).select(*df.columns)
    return whole.union(part)


def gather(schedule: DataFrame, records: DataFrame) -> DataFrame:
    """The records of a schedule, each as often as it is scheduled."""
    return schedule.join(records, ["ds_idx", "sample_idx"])


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """``df`` in an order that depends on seed and id alone."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)


def with_replacement(df: DataFrame, rank_col: str, total: int, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` rows of ``df`` as ``(draw, ...)``, each by a hash of its number.

    ``rank_col`` numbers the rows from 0 to ``total - 1``.
    """
    n = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long")
    asked = df.sparkSession.range(draws if total else 0).select(F.col("id").alias("draw"), F.pmod(n, F.lit(max(total, 1))).alias(rank_col))
    return asked.join(df, rank_col)
