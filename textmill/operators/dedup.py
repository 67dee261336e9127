"""Exact and MinHash deduplication that keeps the first of each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.operators.selfjoin import pairs_by_key
from textmill.runtime import materialize, spread

SHA2 = {"sha256": 256, "sha224": 224, "sha384": 384, "sha512": 512}


def digest(c: Column, algo: str = "sha256") -> Column:
    """Hex digest of the UTF-8 bytes; algorithms Spark lacks run in Arrow batches."""
    if algo in SHA2:
        return F.sha2(c, SHA2[algo])
    if algo in ("md5", "sha1"):
        return getattr(F, algo)(c)

    @F.pandas_udf("string")
    def other(batch: pd.Series) -> pd.Series:
        import hashlib

        return batch.map(lambda t: None if t is None else hashlib.new(algo, t.encode()).hexdigest())

    return other(c)


def first_copies(df: DataFrame, text_col: str, order_col: str, algo: str = "sha256") -> DataFrame:
    """``df`` with ``digest`` and ``first``: is this the first row with its text?

    First in ``order_col``; rows that tie are all first. Null texts have no
    digest and are all first. Only digests and orders are shuffled, combined
    before the shuffle, so one text may hold any share of the rows.
    """
    named = df.withColumn("digest", digest(F.col(text_col), algo))
    least = named.where("digest is not null").groupBy("digest").agg(F.min(order_col).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return named.join(least, "digest", "left").withColumn("first", F.coalesce(F.col(order_col) <= F.col("_least"), F.lit(True))).drop("_least")


def dedupe(df: DataFrame, text_col: str, order_col: str, algo: str = "sha256") -> DataFrame:
    """The first row of each text; null texts all stay. Ties in the order stay."""
    return first_copies(df, text_col, order_col, algo).where("first").select(*df.columns)


def unseen(df: DataFrame, text_col: str, seen: DataFrame, algo: str = "sha256") -> DataFrame:
    """Rows whose digest is not in ``seen(digest)``; null texts stay."""
    named = df.withColumn("_digest", digest(F.col(text_col), algo))
    return named.join(seen.select(F.col("digest").alias("_digest")).distinct(), "_digest", "left_anti").select(*df.columns)


def minhash(df: DataFrame, id_col: str, text_col: str, hashes: int = 128, size: int = 3, hash_name: str = "xxhash64") -> DataFrame:
    """``(id_col, signature)``: the least hash of the word shingles, for each seed.

    Shingles are hashed once; each place of the signature is the least of one
    linear map of the hashes, worked out in Arrow batches.

    Texts of fewer words than ``size`` are one shingle, the lower-cased text.
    ``hash_name='blake2b'`` takes the 8-byte digests of ``seed:shingle``.
    """
    low = F.lower(F.col(text_col))
    shingles = tx.let(low, lambda s: tx.let(tx.words(s), lambda ws: F.when(F.size(ws) < size, F.array(s)).otherwise(F.array_distinct(tx.ngrams(ws, size)))))
    rows = spread(df.select(id_col, text_col)).where(F.col(text_col).isNotNull()).select(F.col(id_col), shingles.alias("shingles"))
    kind = dict(df.dtypes)[id_col]
    if hash_name == "xxhash64":
        r = np.random.default_rng(hashes)
        a, b = r.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, hashes, dtype=np.uint64)

        def minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for h in pdf["h"]:
                    x = np.asarray(h, dtype=np.int64).view(np.uint64)
                    low_ = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(x), 2048):
                        low_ = np.minimum(low_, (x[None, k : k + 2048] * a[:, None] + b[:, None]).min(axis=1))
                    out.append(low_.view(np.int64))
                yield pd.DataFrame({id_col: pdf[id_col], "signature": out})

        return rows.select(id_col, F.transform("shingles", lambda s: F.xxhash64(s)).alias("h")).mapInPandas(minima, f"`{id_col}` {kind}, signature array<long>")

    def blake(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        def one(shingles) -> list[int]:
            out = []
            for seed in range(hashes):
                least = min(int.from_bytes(hashlib.blake2b(f"{seed}:{s}".encode(), digest_size=8).digest(), "little") for s in shingles)
                out.append(least - (1 << 64) if least >= 1 << 63 else least)
            return out

        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "signature": [one(s) for s in pdf["shingles"]]})

    return rows.mapInPandas(blake, f"`{id_col}` {kind}, signature array<long>")


def similar_pairs(signed: DataFrame, id_col: str, threshold: float = 0.8, bands: int | None = None) -> DataFrame:
    """``(a, b, similarity)``, a < b: signatures that agree in enough places.

    With at most d places to differ in, more than d bands leave some band
    equal, so no pair is missed. A sketch of one bit a place is compared inside
    the join, which loses none either. Of equal signatures only the least id takes
    part; the others are linked to it, which keeps copies from pairing with
    each other.
    """
    first = signed.first()
    if first is None:
        return signed.sparkSession.createDataFrame([], "a long, b long, similarity double")
    h = len(first["signature"])
    d = h - -(-int(round(threshold * h * 1e6)) // 1_000_000)
    bands = bands or next((b for b in range(d + 1, h + 1) if h % b == 0), h)
    if bands <= d or h % bands:
        raise ValueError(f"{bands} bands of {h} hashes can miss pairs at {threshold}")
    rows = h // bands
    keyed = materialize(signed.select(F.col(id_col).alias("id"), "signature", F.sha2(F.array_join("signature", ","), 256).alias("whole")), "signatures")
    heads = keyed.groupBy("whole").agg(F.min("id").alias("head"))
    copies = keyed.join(heads, "whole").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    kept = keyed.join(heads, (keyed["whole"] == heads["whole"]) & (keyed["id"] == heads["head"]), "left_semi").select("id", "signature")
    # equal places have equal bits, so two sketches differ in at most d bits
    bits = lambda k: F.aggregate(F.slice("signature", k * 64 + 1, 64), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x.bitwiseAND(1)))
    sketch = [f"s{k}" for k in range(-(-h // 64))]
    whole = kept.select(F.coalesce("id", F.lit(0).cast("long")).alias("uid"), "signature", *[F.coalesce(bits(k), F.lit(0).cast("long")).alias(c) for k, c in enumerate(sketch)])
    banded = whole.select("uid", *sketch, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.slice("signature", k * rows + 1, rows))).alias("band", "part"))
    banded = banded.select("uid", *sketch, F.xxhash64("band", "part").alias("key"))

    def near(l: str, r: str) -> Column:
        return reduce(add, [F.bit_count(F.col(f"{l}.{c}").bitwiseXOR(F.col(f"{r}.{c}"))) for c in sketch]) <= d

    candidates = pairs_by_key(banded, "key", near).distinct()
    same = F.aggregate(F.zip_with("x.signature", "y.signature", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / h
    x, y = kept.alias("x"), kept.alias("y")
    return candidates.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).select("a", "b", same.alias("similarity")).where(F.col("similarity") >= threshold).union(copies)


def greedy_keep(ids: DataFrame, pairs: DataFrame, id_col: str, seen: DataFrame | None = None, max_rounds: int = 200) -> DataFrame:
    """``(id_col, kept)``: in order of id, drop what is similar to an earlier kept one.

    Not a matter of connected components: in a chain A~B~C where A and C differ,
    A and C stay. Settled in rounds over what is still undecided: what has an
    earlier neighbour kept in the last round is dropped, what then waits for
    nobody is kept. Ids without pairs take no part in them.
    ``seen(id)`` are ids kept before.
    """
    everyone = ids.select(F.col(id_col).alias("id")).distinct()
    edges = materialize(pairs.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct(), "edges")
    linked = edges.select(F.col("late").alias("id")).distinct()
    # what nobody earlier is similar to stays, and so does what was kept before
    first = edges.select(F.col("early").alias("id")).distinct().join(linked, "id", "left_anti")
    old = None if seen is None else seen.select("id").distinct()
    kept = first if old is None else first.union(old).distinct()
    open_ = linked if old is None else linked.join(old, "id", "left_anti")
    kept, open_, dropped = materialize(kept, "keep"), materialize(open_, "open"), None
    newly = kept
    for _ in range(max_rounds):
        # only edges between what is undecided, and from what was decided last, go on
        hit = materialize(edges.join(newly.withColumnRenamed("id", "early"), "early").select(F.col("late").alias("id")).distinct().join(open_, "id", "left_semi"), "hit")
        dropped = hit if dropped is None else dropped.union(hit)
        open_ = materialize(open_.join(hit, "id", "left_anti"), "open")
        if not open_.limit(1).count():
            break
        edges = materialize(edges.join(open_.withColumnRenamed("id", "late"), "late", "left_semi"), "edges")
        waiting = edges.join(open_.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct()
        newly = materialize(open_.join(waiting, "id", "left_anti"), "keep")
        open_ = materialize(open_.join(newly, "id", "left_anti"), "open")
        if not open_.limit(1).count():
            break
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    lost = dropped if dropped is not None else everyone.limit(0)
    return everyone.join(lost.distinct().withColumn("_lost", F.lit(True)), "id", "left").select(F.col("id").alias(id_col), F.col("_lost").isNull().alias("kept"))


def minhash_dedupe(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, hashes: int = 128, size: int = 3, hash_name: str = "xxhash64") -> DataFrame:
    """The rows of ``df`` that the greedy rule keeps; null texts all stay."""
    pairs = similar_pairs(materialize(minhash(df, id_col, text_col, hashes, size, hash_name), "minhash"), id_col, threshold)
    dropped = greedy_keep(df.where(F.col(text_col).isNotNull()), pairs, id_col).where("not kept").select(id_col)
    return df.join(dropped, id_col, "left_anti").select(*df.columns)
