"""Packing of token sequences in order, one open bin at a time.

Next fit looks like a fold over all items, but all that an item needs to know of
the ones before it is the room left in the open bin. So ranges of the order are
folded side by side: each says, for every room it may be entered with, with
which room it is left and how many bins it opens. Those maps, whose size depends
on the bin alone, are composed one after the other; then every range knows its
entry and numbers its own items. Only (order, size) pairs move, 16 bytes each;
the sequences are joined to their places afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.runtime import materialize


class _Range:
    """Items of a range of the order, and where bins opened in it end."""

    def __init__(self, sizes: np.ndarray, room: int, gap: int, spared: int):
        self.room, self.spared = room, spared
        self.m = len(sizes)
        self.ends = np.cumsum(sizes.astype(np.int64) + gap)
        self.before = np.concatenate([[0], self.ends[:-1]])
        self.limit = self.before + room + spared  # a bin opened at an item reaches up to here
        self.next = np.maximum(np.searchsorted(self.ends, self.limit, "right"), np.arange(self.m) + 1)
        # a bin that counts the gap of its first item, too
        self.very_next = max(1, int(np.searchsorted(self.ends, room, "right")))

    def opens(self, rooms: np.ndarray) -> np.ndarray:
        """The first item that opens a bin, for each room at the entry; -1 is less than none."""
        return np.where(rooms < 0, 0, np.searchsorted(self.ends, rooms, "right"))

    def maps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rooms -1 to ``room``, and for no bin at all: room and items of the
        open bin at the exit, and bins opened; where none is, the items of the range."""
        m, total = self.m, int(self.ends[-1])
        left, items, bins = [0] * m, [0] * m, [0] * m
        limit, following = self.limit.tolist(), self.next.tolist()
        for j in range(m - 1, -1, -1):
            k = following[j]
            if k == m:
                left[j], items[j], bins[j] = max(-1, limit[j] - total), m - j, 1
            else:
                left[j], items[j], bins[j] = left[k], items[k], bins[k] + 1
        k = self.very_next
        very = (max(-1, self.room - total), m, 1) if k >= m else (left[k], items[k], bins[k] + 1)
        rooms = np.arange(-1, self.room + 1)
        at = self.opens(rooms)
        fits, at = at >= m, np.minimum(at, m - 1)
        pick = lambda values, kept, last: np.concatenate([np.where(fits, kept, np.array(values)[at]), [last]])
        return pick(left, rooms - total, very[0]), pick(items, m, very[1]), pick(bins, 0, very[2])

    def places(self, entry: int | None, bin_: int, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, slot and start of each item; ``entry`` is the room, none at the very start."""
        first = 0 if entry is None else int(self.opens(np.array([entry]))[0])
        openers = []
        j = first
        while j < self.m:
            openers.append(j)
            j = self.very_next if entry is None and j == 0 else int(self.next[j])
        index = np.arange(self.m)
        own = np.searchsorted(openers, index, "right") - 1
        carried = own < 0
        head = np.array(openers or [0])[np.maximum(own, 0)]
        spared = np.where((entry is None) & (head == 0), 0, self.spared)
        used = self.room - (entry if entry is not None else self.room)
        return bin_ + own + 1, np.where(carried, slot + index, index - head), np.where(carried, used + self.before, self.before - self.before[head] - np.where(index > head, spared, 0))


def next_fit(sizes: DataFrame, max_length: int, shards: int = 1, longest_first: bool = False, gap: int = 0, first_counts_gap: bool = False, parts: int | None = None) -> DataFrame:
    """``(shard, bin, slot, pos, start)`` of ``sizes(pos, size)``.

    ``gap`` is added for each item; with ``first_counts_gap`` only the very
    first bin counts it for its first item. An item that alone exceeds the
    bin gets one for itself. One shard is the total order; with more, rows are
    dealt by a hash of ``pos`` and every shard packs its own. The result is the
    same for any number of ``parts``, the ranges that are packed side by side.
    """
    spared = gap if first_counts_gap else 0
    order = ["size", "pos"] if longest_first else ["pos"]
    rising = [not longest_first, True] if longest_first else [True]
    keys = ["shard", F.desc("size"), "pos"] if longest_first else ["shard", "pos"]
    rows = sizes.select(F.pmod(F.xxhash64("pos"), F.lit(shards)).cast("int").alias("shard"), F.col("pos").cast("long").alias("pos"), F.col("size").cast("long").alias("size"))
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")

    def sorted_(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(order, ascending=rising, kind="stable")

    def maps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _Range(sorted_(pdf)["size"].to_numpy(), max_length, gap, spared).maps()
        return pd.DataFrame([(int(key[0]), int(key[1]), *[x.astype(np.int64).tobytes() for x in found])], columns=["shard", "part", "room", "items", "bins"])

    entries: dict[tuple[int, int], tuple[int | None, int, int]] = {}
    shard, room, bin_, slot = None, None, -1, 0
    composed = ranged.groupBy("shard", "part").applyInPandas(maps, "shard int, part int, room binary, items binary, bins binary").orderBy("shard", "part")
    for r in composed.toLocalIterator():  # one row a range, of a size that the bin sets
        if r["shard"] != shard:
            shard, room, bin_, slot = r["shard"], None, -1, 0
        entries[(shard, r["part"])] = (room, bin_, slot)
        at = max_length + 2 if room is None else room + 1
        out, items, bins = (int(np.frombuffer(r[c], np.int64)[at]) for c in ("room", "items", "bins"))
        room, bin_, slot = out, bin_ + bins, items if bins else slot + items

    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_(pdf)
        b, s, start = _Range(pdf["size"].to_numpy(), max_length, gap, spared).places(*entries[(int(key[0]), int(key[1]))])
        return pd.DataFrame({"shard": int(key[0]), "bin": b, "slot": s, "pos": pdf["pos"].to_numpy(), "start": start})

    return ranged.groupBy("shard", "part").applyInPandas(label, "shard int, bin long, slot long, pos long, start long")


def pack_sequences(df: DataFrame, order_col: str, tokens_col: str, max_length: int, eos: int = 0, pad: int = 0, shards: int = 1) -> DataFrame:
    """``(shard, bin, tokens, used, truncated)``: bins of ``max_length`` tokens.

    Longest first, equal lengths in order; each sequence is followed by
    ``eos``; bins are filled up with ``pad``. A sequence that doesn't fit a bin
    loses its tail, and its ``eos``. Null sequences are left out, empty ones
    give an ``eos``.
    """
    rows = df.where(F.col(tokens_col).isNotNull()).select(F.col(order_col).cast("long").alias("pos"), F.col(tokens_col).cast("array<int>").alias("seq"))
    placed = next_fit(rows.select("pos", (F.size("seq") + 1).alias("size")), max_length, shards, longest_first=True)
    full = rows.join(placed, "pos").withColumn("seq", F.concat("seq", F.array(F.lit(eos)))).groupBy("shard", "bin").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "seq"))), lambda x: x["seq"])).alias("all")
    )
    return full.select(
        "shard", "bin", F.concat(F.slice("all", 1, max_length), F.array_repeat(F.lit(pad), F.greatest(F.lit(max_length) - F.size("all"), F.lit(0)))).alias("tokens"),
        F.least(F.size("all"), F.lit(max_length)).alias("used"), F.greatest(F.size("all") - max_length, F.lit(0)).alias("truncated"),
    )


def packing_efficiency(df: DataFrame, tokens_col: str, packed: DataFrame, max_length: int, packed_col: str = "tokens") -> DataFrame:
    """One row: efficiency and waste of the sequences in their bins.

    ``efficiency`` divides sequence tokens, without end marks, by capacity, so
    it passes 1 where sequences were cut; ``fill`` divides by what was used.
    No bins give 0.
    """
    have = df.agg(F.count(tokens_col).alias("num_sequences"), F.coalesce(F.sum(F.size(tokens_col)), F.lit(0)).cast("long").alias("total_tokens"))
    bins = packed.agg(F.count(F.lit(1)).alias("num_packed"), F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("used_tokens"))
    capacity = F.col("num_packed") * max_length
    efficiency = F.when(capacity > 0, F.col("total_tokens") / capacity).otherwise(0.0)
    return have.crossJoin(bins).select(  # one row each
        "num_sequences", "num_packed", "total_tokens", capacity.alias("capacity"), efficiency.alias("efficiency"),
        F.when(capacity > 0, 1 - F.col("total_tokens") / capacity).otherwise(0.0).alias("waste"), F.when(capacity > 0, F.col("used_tokens") / capacity).otherwise(0.0).alias("fill"),
    )
