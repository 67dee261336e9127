"""Byte-level byte-pair encodings: pair counts, encoding, decoding, merges as tables.

Tokenizers come from outside: merges are a table ``(left, right, new_id)`` in
Parquet, or a rank file of a public tokenizer. Texts are bounds for pairs: no
pair spans two texts.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.runtime import spread

MOST_MERGES = 1_000_000


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(?s).."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def pair_counts(df: DataFrame, ids_col: str) -> DataFrame:
    """``(left, right, n)`` of adjacent ids, combined before the shuffle."""
    ids = F.col(ids_col)
    pairs = F.arrays_zip(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))).alias("l"), F.slice(ids, F.lit(2), F.greatest(F.size(ids), F.lit(1))).alias("r"))
    return df.where(F.size(ids) > 1).select(F.explode(pairs).alias("p")).groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.count(F.lit(1)).alias("n"))


def merges_of_ranks(spark: SparkSession, path: str, limit: int = MOST_MERGES) -> DataFrame:
    """Merges ``(left, right, new_id)`` of a public rank file, over byte ids.

    A token of several bytes is split where its two parts have the least
    greatest rank, as the encoding would have made it. Ids are 0-255 for
    bytes, then in order of rank.
    """
    ranks = {}
    for line in open(path, "rb"):
        token, _, rank = line.strip().partition(b" ")
        ranks[base64.b64decode(token)] = int(rank)
    order = sorted((t for t in ranks if len(t) > 1), key=lambda t: ranks[t])[:limit]
    ids = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(order)}
    rows = []
    for t in order:
        cuts = [(max(ranks[t[:k]], ranks[t[k:]]), k) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids and ids[t[:k]] < ids[t] and ids[t[k:]] < ids[t]]
        if cuts:
            k = min(cuts)[1]
            rows.append((ids[t[:k]], ids[t[k:]], ids[t]))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["left", "right", "new_id"]), "left int, right int, new_id int")


def _collected(merges: DataFrame) -> dict[tuple[int, int], int]:
    rows = merges.limit(MOST_MERGES + 1).collect()
    if len(rows) > MOST_MERGES:
        raise ValueError(f"more than {MOST_MERGES} merges")
    return {(r["left"], r["right"]): r["new_id"] for r in rows}


def save_merges(merges: DataFrame, path: str) -> None:
    """The table ``(left, right, new_id)`` as JSON lines, replaced as a whole."""
    merges.select("left", "right", "new_id").orderBy("new_id").coalesce(1).write.mode("overwrite").json(path)


def load_merges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("left int, right int, new_id int").json(path)


def apply_merges(ids: list[int], table: dict[tuple[int, int], int], newest_first: bool) -> list[int]:
    """Merge the pair of highest (or lowest) id that is present, until none is.

    All pairs of one id are merged from left to right before any pair that
    this makes. Pairs wait in a heap, neighbours are linked, so a text of n
    bytes takes n log n steps.
    """
    n = len(ids)
    ids, after, before = list(ids), [*range(1, n), -1], list(range(-1, n - 1))
    sign = -1 if newest_first else 1
    heap = [(sign * table[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in table]
    heapify(heap)
    while heap:
        new, made = heap[0][0], []
        while heap and heap[0][0] == new:
            k = heappop(heap)[1]
            r = after[k]
            if ids[k] < 0 or r < 0 or table.get((ids[k], ids[r])) != sign * new:
                continue
            ids[k], ids[r], after[k] = sign * new, -1, after[r]
            if after[k] >= 0:
                before[after[k]] = k
            made.append(k)
        for k in made:
            for left in (before[k], k):
                if left >= 0 and ids[left] >= 0 and after[left] >= 0:
                    p = table.get((ids[left], ids[after[left]]))
                    if p is not None:
                        heappush(heap, (sign * p, left))
    return [x for x in ids if x >= 0]


def encode(df: DataFrame, text_col: str, merges: DataFrame, order: str = "newest", out_col: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts; null stays null.

    ``order='newest'`` always merges the known pair made last, ``'rank'`` the
    one made first, which is what usual encoders do.
    """
    sent = df.sparkSession.sparkContext.broadcast(_collected(merges))

    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        table = sent.value
        return batch.map(lambda t: None if t is None else apply_merges(list(t.encode()), table, order == "newest"))

    return spread(df).withColumn(out_col, run(text_col))


def decode(df: DataFrame, ids_col: str, merges: DataFrame, out_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids and ``unknown_ids``, which are left out of it.

    Bytes that are no UTF-8 become the replacement character.
    """
    table = _collected(merges)
    vocab = {k: bytes([k]) for k in range(256)}
    for (l, r), new in sorted(table.items(), key=lambda x: x[1]):
        if l in vocab and r in vocab:
            vocab[new] = vocab[l] + vocab[r]
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("struct<text:string,unknown:int>")
    def run(batch: pd.Series) -> pd.DataFrame:
        v = sent.value
        rows = [(None, None) if ids is None else (b"".join(v.get(int(i), b"") for i in ids).decode("utf-8", "replace"), sum(int(i) not in v for i in ids)) for ids in batch]
        return pd.DataFrame(rows, columns=["text", "unknown"])

    return df.withColumn("_d", run(ids_col)).withColumns({out_col: F.col("_d.text"), "unknown_ids": F.col("_d.unknown")}).drop("_d")
