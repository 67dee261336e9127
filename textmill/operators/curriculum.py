"""Ordering by difficulty and dividing into stages.

Ranks over a whole table come without a window over it: the rows are range
partitioned by the order, counted by partition, and numbered from the sum of
the partitions before. Only the counts, one number a partition, meet.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.runtime import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in ``order``, which should be total."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in ``order`` within each group, null keys included.

    Ranks over the whole table less the first one of the group: no task gets a
    whole group, however large.
    """
    ranked = global_rank(df, [*[F.asc(c) for c in by], *order], "_place")
    if not by:
        return ranked.withColumnRenamed("_place", name)
    keys = [f"_key{i}" for i in range(len(by))]
    first = ranked.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.min("_place").alias("_first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)])
    return ranked.join(first, same).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first", *keys)


def order_by_difficulty(df: DataFrame, score: Column, pos_col: str, reverse: bool = False, name: str = "rank") -> DataFrame:
    """``df`` with ``difficulty`` and its rank; ties keep the input order either way."""
    scored = df.withColumn("difficulty", score.cast("double"))
    return global_rank(scored, [F.desc("difficulty") if reverse else F.asc("difficulty"), F.asc(pos_col)], name)


def length_score(tokens: Column) -> Column:
    return F.size(tokens).cast("double")


def schedule(ranked: DataFrame, total: int, stages: int = 4, kind: str = "linear", rank_col: str = "rank") -> DataFrame:
    """``ranked`` with ``stage``, a row for each stage that has the item.

    ``total // stages`` items a stage, the last one takes the rest. In a
    ``linear`` schedule a stage also has all items before it.
    """
    if stages < 1:
        raise ValueError("at least one stage")
    width = total // stages
    own = F.least(F.floor(F.col(rank_col) / width), F.lit(stages - 1)).cast("int") if width else F.lit(stages - 1)
    if kind != "linear":
        return ranked.withColumn("stage", own)
    return ranked.withColumn("stage", F.explode(F.sequence(own, F.lit(stages - 1))))


def stage_for_epoch(epoch: Column, total_epochs: Column, stages: int = 4) -> Column:
    return F.least(F.floor(epoch / total_epochs * stages), F.lit(stages - 1)).cast("int")
