"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

1. Sizes are brought to a grid of LEVELS steps, rounded up, and counted. The
   histogram has at most LEVELS rows, whatever the number of items.
2. All patterns of at most DOCS_IN_PATTERN items that fill a container exactly
   on the grid are enumerated; non-negative least squares (active set) fits how
   often each is to be used so that together they use up the histogram.
3. Repeats are rounded down. Items are spread over shards of about SHARD_ITEMS
   by a hash of their id, each a likeness of the whole; every shard plays its
   share of the patterns. The places of a pattern are filled from their
   levels, the last one by an item whose exact size completes the container,
   and what room is left by the largest items that fit. Containers not full
   are undone. What remains is packed largest first, the best fit next. A shard leaves at most one container open, about one in ten thousand.

Only (id, size) rows are shuffled, never texts. Items longer than a container
are cut into full containers and one rest, which is an item like others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.runtime import materialize

LEVELS, DOCS_IN_PATTERN, SHARD_ITEMS, TRIES, WEIGHT_POWER = 128, 3, 50_000, 24, 4
#: More containers kinds than this are not sent to the driver at once.
MOST_TARGETS = 1000

_PLACED = "pack_id string, container long, position int, id long, piece int, piece_start long, piece_length long"


def chatml_size(messages: str = "messages") -> Column:
    """Characters of the ChatML rendering; null where there are no messages."""
    role = lambda m: F.when(m["role"].isNull(), F.lit("unknown")).when(m["role"] == "human", F.lit("user")).when(m["role"] == "gpt", F.lit("assistant")).otherwise(m["role"])
    fixed = len("<|im_start|>") + len("\n") + len("<|im_end|>")
    one = lambda m: (F.length(role(m)) + F.length(F.coalesce(m["content"], F.lit(""))) + fixed).cast("long")
    kept = F.filter(messages, lambda m: m.isNotNull())
    total = F.aggregate(F.transform(kept, one), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(kept) > 0, total + F.size(kept) - 1)


def patterns(levels: int, docs: int = DOCS_IN_PATTERN) -> list[tuple[int, ...]]:
    """Falling sequences of at most ``docs`` levels that sum to ``levels``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < docs:
            for x in range(min(most, left), 0, -1):
                if x * (docs - len(head)) < left:
                    break
                extend((*head, x), left - x, x)

    extend((), levels, levels)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set of columns."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    limit = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        slope = right - gram @ x
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= limit:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(on, on)], right[on], rcond=1e-10)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            low = s <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += step * (s - x[on])
            gone = on[(x[on] <= 1e-12) & low]
            active[gone if len(gone) else on[low]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def fit(histogram: dict[int, int], levels: int = LEVELS) -> list[tuple[tuple[int, ...], float]]:
    """Patterns and how often each is used, for a histogram of levels."""
    total = sum(histogram.values())
    if not total:
        return []
    b = np.array([histogram.get(k, 0) / total for k in range(1, levels + 1)])
    held = [p for p in patterns(levels) if all(histogram.get(k, 0) for k in p)]
    if not held:
        return []
    a = np.zeros((levels, len(held)))
    for j, p in enumerate(held):
        for k in p:
            a[k - 1, j] += 1
    weigh = (np.arange(1, levels + 1) / levels) ** WEIGHT_POWER  # what stays of large items costs room, small ones fill gaps
    x = nnls(a * weigh[:, None], b * weigh) * total
    return sorted(((p, float(r)) for p, r in zip(held, x) if r > 0), key=lambda t: (-t[1], t[0]))


class _Stock:
    """Items by exact size, with the largest of at most a given size at hand."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.by: dict[int, list[int]] = defaultdict(list)
        self.bits = 0
        for k in np.lexsort((ids, sizes))[::-1]:
            self.by[int(sizes[k])].append(k)
        for s in self.by:
            self.bits |= 1 << s

    def largest(self, most: int, least: int = 0) -> int | None:
        """Size of the largest item in [least, most]."""
        if most < 0:
            return None
        s = (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1
        return s if s >= least and s >= 0 else None

    def take(self, size: int) -> int:
        rows = self.by[size]
        k = rows.pop()
        if not rows:
            self.bits &= ~(1 << size)
        return k

    def put(self, size: int, k: int) -> None:
        self.by[size].append(k)
        self.bits |= 1 << size


def pack(ids: np.ndarray, sizes: np.ndarray, room: int, plan: list[tuple[tuple[int, ...], float]], share: float, levels: int = LEVELS) -> list[list[int]]:
    """Containers of row numbers; ``sizes`` are at most ``room``, joiners included.

    A pattern says from which levels the items come. Which of a level is left
    to the exact sizes: the place before the last tries TRIES sizes of its
    level for one that another item completes to the full room. Containers
    that come out less than full by more than a thousandth are taken apart
    again; their items go to the rest.
    """
    stock, step, spare = _Stock(ids, sizes), -(-room // levels), room // 1000
    full: list[list[int]] = []

    def in_level(level: int, most: int) -> Iterator[int]:
        s = stock.largest(min(most, level * step), (level - 1) * step + 1)
        for _ in range(TRIES):
            if s is None:
                return
            yield s
            s = stock.largest(s - 1, (level - 1) * step + 1)

    def chosen(pattern: tuple[int, ...]) -> list[int]:
        """Sizes for the places of a pattern, the fullest of those tried."""
        head, left = [], room
        for level in pattern[:-2]:
            s = next(in_level(level, left), None)
            if s is None:
                return []
            head.append(s)
            left -= s
        if len(pattern) == 1:
            s = stock.largest(left)
            return [s] if s is not None else []
        best: list[int] = []
        for s in in_level(pattern[-2], left):
            if head.count(s) >= len(stock.by[s]):
                continue
            last = stock.largest(left - s)
            got = [s] if last is None or [*head, s].count(last) >= len(stock.by[last]) else [s, last]
            if sum(got) > sum(best):
                best = got
            if sum(best) == left:
                break
        return head + best if best else []

    for pattern, repeats in plan:
        for _ in range(int(repeats * share)):
            picked = chosen(pattern)
            if not picked:
                break
            rows, left = [], room - sum(picked)
            for s in picked:
                rows.append(stock.take(s))
            while (s := stock.largest(left)) is not None:
                rows.append(stock.take(s))
                left -= s
            if left > spare:
                for k in rows:
                    stock.put(int(sizes[k]), k)
                break
            full.append(rows)
    while (s := stock.largest(room)) is not None:
        rows, left = [], room
        while s is not None:
            rows.append(stock.take(s))
            left -= s
            s = stock.largest(left)
        full.append(rows)
    return full


def fill_containers(items: DataFrame, targets: DataFrame, id_col: str, size_col: str) -> DataFrame:
    """``(pack_id, container, position, id_col, piece, piece_start, piece_length)``.

    ``targets`` has ``pack_id, max_length, joiner_length``; all items go into
    the containers of each. Positions count from 0 within a container; between
    two neighbours there is room for a joiner. An item is whole (piece 0 of
    length size) unless it exceeds ``max_length``; then its pieces are
    numbered in order, all but the last of full length.

    Ids are whole numbers. Rows of one id count once, with the largest size. Null ids or sizes, and
    sizes below one, take no part. Targets of null or non-positive length are
    left out, null joiners are none. No items or no targets give no rows.
    """
    goals = {r["pack_id"]: (int(r["max_length"]), int(r["joiner_length"] or 0)) for r in targets.where("max_length > 0").select("pack_id", "max_length", "joiner_length").distinct().limit(MOST_TARGETS + 1).collect()}
    if len(goals) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} kinds of containers")
    spark = items.sparkSession
    if not goals:
        return spark.createDataFrame([], _PLACED.replace(", id long", f", `{id_col}` long"))
    sized = (
        items.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size")).where("id is not null and size > 0")
        .groupBy("id").agg(F.max("size").alias("size"))
    )
    sized = materialize(sized, "sizes")
    each = [F.struct(F.lit(k).alias("pack_id"), F.lit(m).cast("long").alias("most"), F.lit(j).cast("long").alias("joiner")) for k, (m, j) in goals.items()]
    every = sized.select("id", "size", F.inline(F.array(*each)))
    rest = every.withColumn("whole", F.when(F.col("size") > F.col("most"), F.floor((F.col("size") - 1) / F.col("most"))).otherwise(F.lit(0)).cast("int")).withColumn("rest", F.col("size") - F.col("whole") * F.col("most"))
    grid = F.ceil((F.col("rest") + F.col("joiner")) / F.ceil((F.col("most") + F.col("joiner")) / LEVELS))
    histograms: dict[str, dict[int, int]] = defaultdict(dict)
    for r in rest.groupBy("pack_id", grid.cast("int").alias("level")).count().collect():  # at most LEVELS rows a target
        histograms[r["pack_id"]][r["level"]] = r["count"]
    plans = {k: fit(h) for k, h in histograms.items()}
    totals = {k: sum(h.values()) for k, h in histograms.items()}
    shards = max(1, -(-max(totals.values(), default=0) // SHARD_ITEMS))
    sent = spark.sparkContext.broadcast((goals, plans, totals))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        goals_, plans_, totals_ = sent.value
        name, shard = key
        most, joiner = goals_[name]
        pdf = pdf.sort_values("id")
        ids, rests, wholes = pdf["id"].to_numpy(), pdf["rest"].to_numpy(), pdf["whole"].to_numpy()
        packed = pack(ids, rests + joiner, most + joiner, plans_.get(name, []), len(pdf) / max(1, totals_.get(name, 1)))
        base, rows = int(shard) << 32, []
        for n, members in enumerate(packed):
            for pos, k in enumerate(members):
                rows.append((name, base + n, pos, ids[k], wholes[k], wholes[k] * most, rests[k]))
        n = len(packed)
        for k in np.flatnonzero(wholes):
            for piece in range(wholes[k]):
                rows.append((name, base + n, 0, ids[k], piece, piece * most, most))
                n += 1
        return pd.DataFrame(rows, columns=["pack_id", "container", "position", "id", "piece", "piece_start", "piece_length"])

    placed = rest.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("pack_id", "shard").applyInPandas(place, _PLACED)
    return placed.withColumnRenamed("id", id_col)


def container_report(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target the containers, the room they have and the share unused.

    Joiners between the items of a container count as used.
    """
    goals = targets.select("pack_id", "max_length", F.coalesce("joiner_length", F.lit(0)).alias("joiner")).distinct()
    each = placed.groupBy("pack_id", "container").agg(F.sum("piece_length").alias("filled"), F.count(F.lit(1)).alias("items"))
    total = each.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("filled").alias("filled"))
    used = F.col("filled") + F.col("joiner") * (F.col("items") - F.col("containers"))
    return total.join(goals, "pack_id").select(
        "pack_id", "containers", "items", "filled", (F.col("containers") * F.col("max_length")).alias("room"),
        (1 - used / (F.col("containers") * F.col("max_length"))).alias("unused_share"),
    )
