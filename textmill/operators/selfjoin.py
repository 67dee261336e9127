"""Pairs of rows that share a key, with large groups split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups over so many rows are split.
BUCKET = 2000


def pairs_by_key(rows: DataFrame, key: str, cond: Callable[[str, str], Column], bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: ids ``uid`` of rows with equal ``key`` that meet ``cond``, a < b.

    ``cond(l, r)`` is a condition on the columns of the two sides; it is tried
    inside the join, so only pairs that meet it come out. A pair comes once for
    each key it shares. Rows of null key meet nobody.

    Both sides of ordinary groups come from one shuffle on the key. Groups
    over ``bucket`` rows are split: one side takes one salt, the other all of
    them, so a task gets at most ``bucket`` rows on one side whatever a key
    holds. Columns that can't be null keep both sides' plans equal, which lets
    Spark use the shuffle twice.
    """
    hot = rows.groupBy(key).count().where(F.col("count") > bucket).select(key, F.ceil(F.col("count") / bucket).cast("int").alias("parts"))
    cold = rows.join(hot, key, "left_anti")
    large = rows.join(hot, key)
    one = large.withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    every = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    same = F.col(f"l.{key}") == F.col(f"r.{key}")
    ordered = F.col("l.uid") < F.col("r.uid")
    found = (F.col("l.uid").alias("a"), F.col("r.uid").alias("b"))
    plain = cold.alias("l").join(cold.alias("r"), same & ordered & cond("l", "r")).select(*found)
    split = one.alias("l").join(every.alias("r"), same & (F.col("l.salt") == F.col("r.salt")) & ordered & cond("l", "r")).select(*found)
    return plain.union(split)
