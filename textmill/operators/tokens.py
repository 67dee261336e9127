"""Token windows, corpus tokenization, file checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windows(tokens: Column, block: int) -> Column:
    """All ``(idx, x, y)`` of an array, stride 1: y is x moved on by one.

    Null and short arrays have none.
    """
    last = F.size(tokens) - block - 1
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("idx"), F.slice(tokens, i + 1, block).alias("x"), F.slice(tokens, i + 2, block).alias("y")))
    kind = "array<struct<idx:int,x:array<int>,y:array<int>>>"
    return F.when(last >= 0, many.cast(kind)).otherwise(F.array().cast(kind))


def stream_windows(df: DataFrame, block: int, pos: str = "pos", token: str = "token", shard: int = 1_000_000) -> DataFrame:
    """``(idx, x, y)`` over one long token stream ``(pos, token)``.

    The stream is cut into shards, each with the first ``block`` tokens of the
    next one, so windows are made in parallel and none is lost.
    """
    home = F.floor(F.col(pos) / shard).cast("long")
    spread = df.select(F.col(pos).alias("pos"), F.col(token).alias("token"), home.alias("home")).withColumn(
        "part", F.explode(F.when((F.pmod("pos", F.lit(shard)) < block) & (F.col("home") > 0), F.array(F.col("home") - 1, F.col("home"))).otherwise(F.array("home")))
    )
    w = Window.partitionBy("part").orderBy("pos").rowsBetween(0, block)
    full = spread.withColumn("run", F.collect_list("token").over(w)).where((F.col("part") == F.col("home")) & (F.size("run") == block + 1))
    return full.select(F.col("pos").alias("idx"), F.slice("run", 1, block).alias("x"), F.slice("run", 2, block).alias("y"))


def tokenize_corpus(df: DataFrame, id_col: str, text_col: str, make_encoder: Callable[[], Callable[[str], list[int]]], eot: int | None = None) -> DataFrame:
    """``(id_col, tokens)`` with the end mark after each text; null texts are left out.

    ``make_encoder`` is called once a Python worker.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, tail = make_encoder(), [] if eot is None else [eot]
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "tokens": [[*encode(t), *tail] for t in pdf["_text"]]})

    return df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text")).mapInPandas(run, f"`{id_col}` {kind}, tokens array<int>")


def char_vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """``(id, char)``: the characters of a corpus, in order."""
    chars = df.where(F.col(text_col).isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit("(?s)."), F.lit(0)))).alias("char")).distinct()
    return chars.select((F.row_number().over(Window.orderBy("char")) - 1).alias("id"), "char")  # an alphabet


def char_encode(text: Column, stoi: Column) -> Column:
    """Ids of the characters by a map column; unknown characters are left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: stoi[c]), lambda i: i.isNotNull())


def char_decode(ids: Column, itos: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: itos[i]), "")


def split_path(path: str, want: str) -> str:
    """The sibling file of the ``train`` or ``val`` split.

    ``a_train.bin`` and ``a_val.bin`` stand for each other, as do ``train.bin``
    and ``val.bin`` of a folder; any other name gets the split as its ending.
    """
    folder, slash, file = path.rpartition("/")
    stem, dot, ext = file.rpartition(".")
    if not dot:
        stem, ext = file, ""
    if stem in ("train", "val"):
        return f"{folder}{slash}{want}{dot}{ext}"
    for tail in ("_train", "_val"):
        if stem.endswith(tail):
            stem = stem[: -len(tail)]
            break
    return f"{folder}{slash}{stem}_{want}{dot}{ext}"


def validate_token_files(spark: SparkSession, path: str, dtype: str = "uint16") -> DataFrame:
    """``(path, size_bytes, num_tokens, dtype, sha256, problem)`` of token files.

    Names come from the listing of the folder, or are those a pattern matches;
    a file is digested as a stream where it lies, so its size doesn't matter.
    Like the token source this needs a folder that is mounted everywhere.
    """
    width = {"uint16": 2, "uint32": 4}[dtype]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.listStatus(where) if fs.exists(where) and fs.getFileStatus(where).isDirectory() else fs.globStatus(where) or []
    names = [(s.getPath().toString(), s.getLen()) for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    files = spark.createDataFrame(names, "path string, length long").repartition(max(1, min(len(names), 1000)), "path")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                sha = hashlib.sha256()
                with open(p.removeprefix("file://").removeprefix("file:"), "rb") as f:
                    while block := f.read(1 << 22):
                        sha.update(block)
                out.append(sha.hexdigest())
            yield pdf.assign(sha256=out)

    done = files.mapInPandas(digest, "path string, length long, sha256 string")
    problem = F.when(F.col("length") == 0, "empty").when(F.col("length") % width != 0, f"size is no multiple of {width}")
    return done.select("path", F.col("length").alias("size_bytes"), F.floor(F.col("length") / width).alias("num_tokens"), F.lit(dtype).alias("dtype"), "sha256", problem.alias("problem"))
