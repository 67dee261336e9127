"""Flat binary token files as a Spark data source, both ways.

``spark.read.format("tokenbin").option("dtype", "uint16").load(path)`` gives
``(pos, token)``, in byte ranges of ``rangeTokens`` tokens read in parallel.
Writing takes ``(pos, token)`` sorted within partitions by ``pos`` and makes a
folder of part files whose names hold the first position, so that their order
is the order of the tokens; ``merge_parts`` puts them into one file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

TYPES = {"uint16": (np.uint16, 2), "uint32": (np.uint32, 4)}
SNIFFED_TOKENS = 100_000
RANGE_TOKENS = 4_000_000


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".bin") and not f.startswith(("_", ".")))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def sniff_type(path: str) -> str:
    """Guess the width: 32 bits if, read so, some early value exceeds 16 bits.

    This takes many 16-bit files of even length for 32-bit ones; name the type
    wherever it is known.
    """
    size = os.path.getsize(path)
    if size == 0 or size % 4:
        return "uint16"
    head = np.fromfile(path, dtype=np.uint32, count=SNIFFED_TOKENS)
    return "uint32" if head.size and int(head.max()) > 65_535 else "uint16"


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int
    base: int
    dtype: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.dtype, self.block = options["path"], options.get("dtype", "uint16"), int(options.get("rangetokens", options.get("rangeTokens", RANGE_TOKENS)))

    def partitions(self) -> list[InputPartition]:
        out, base = [], 0
        for f in files_of(self.path):
            dtype = sniff_type(f) if self.dtype == "auto" else self.dtype
            size = os.path.getsize(f)
            if size == 0:
                raise ValueError(f"empty token file: {f}")
            if size % TYPES[dtype][1]:
                raise ValueError(f"size of {f} is no multiple of {TYPES[dtype][1]}")
            n = size // TYPES[dtype][1]
            out += [_Range(f, k, min(self.block, n - k), base + k, dtype) for k in range(0, n, self.block)]
            base += n
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind, width = TYPES[part.dtype]
        with open(part.path, "rb") as f:
            f.seek(part.first * width)
            done = 0
            while done < part.count:
                got = np.frombuffer(f.read(min(65_536, part.count - done) * width), dtype=kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int64) + part.base + done), pa.array(got.astype(np.int64))], names=["pos", "token"])
                done += len(got)


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    final: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.dtype = options["path"].removeprefix("file://"), options.get("dtype", "uint16")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        kind, _ = TYPES[self.dtype]
        os.makedirs(self.path, exist_ok=True)
        name, first, last, f = os.path.join(self.path, f"_{uuid.uuid4().hex}"), None, -1, None
        try:
            for b in batches:
                pos, tok = b.column("pos").to_numpy(), b.column("token").to_numpy()
                if not len(pos):
                    continue
                if tok.min() < 0 or tok.max() > np.iinfo(kind).max:
                    raise ValueError(f"tokens outside {self.dtype}")
                if pos[0] <= last or (np.diff(pos) <= 0).any():
                    raise ValueError("rows of a partition must be sorted by pos")
                if first is None:
                    first, f = int(pos[0]), open(name, "wb")
                last = int(pos[-1])
                f.write(tok.astype(kind).tobytes())
        finally:
            if f:
                f.close()
        return _Part(name, f"part-{first:020d}.bin") if first is not None else _Part(None, None)

    def commit(self, messages: list[_Part | None]) -> None:
        for m in messages:
            if m and m.name:
                os.replace(m.name, os.path.join(self.path, m.final))

    def abort(self, messages: list[_Part | None]) -> None:
        for m in messages:
            if m and m.name and os.path.exists(m.name):
                os.remove(m.name)


class TokenBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return "pos long, token long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenBin)


def merge_parts(folder: str, target: str) -> int:
    """One file of the parts, in order; gives its bytes. Streams, never loads."""
    done = 0
    with open(target, "wb") as out:
        for f in files_of(folder):
            with open(f, "rb") as part:
                while block := part.read(1 << 22):
                    out.write(block)
                    done += len(block)
    return done


