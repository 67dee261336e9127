"""Evaluation texts inside a corpus: greedy string tiling over shared seeds.

For a document and an item, runs of tokens that both hold are marked longest
first, never overlapping, until none of at least ``min_run`` tokens is left.
The first tile is the longest run in common; all tiles together are the share
of the item that the document covers, which also catches passages put in
another order.

Every run of ``min_run`` item tokens is a seed, found in the documents by a
running Karp-Rabin hash and compared token by token before it counts. A
document token that no item has breaks all runs, so most of a text is passed
over after one look-up per token.

The corpus is read once and never shuffled. The items are a query set of
stated size: they are sent to the executors in blocks of at most
``BLOCK_CHARS`` characters, each of which is one pass over the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.words import WORD
from textmill.runtime import spread

BLOCK_CHARS = 16_000_000
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def tokens(text: str, dense: bool) -> list[str]:
    """Words, or single letters and digits for scripts without blanks."""
    ws = WORD.findall(text.lower())
    return list("".join(ws)) if dense else ws


class Seeds:
    """Items of one kind of token with the hashes of their runs."""

    def __init__(self, items: list[tuple[object, str]], dense: bool, size: int):
        self.dense, self.size = dense, size
        self.ids: dict[str, int] = {}
        self.items: list[tuple[object, list[int]]] = []
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in tokens(text, dense)]
            if len(seq) < size:
                continue
            for p, h in self._hashes(seq):
                self.at[h].append((len(self.items), p))
            self.items.append((key, seq))
        self.top = pow(_BASE, size - 1, _MOD)

    def _hashes(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """Running hash of each run of ``size`` known tokens; 0 is unknown."""
        n, h, known, top = self.size, 0, 0, pow(_BASE, self.size - 1, _MOD)
        for p, x in enumerate(seq):
            if not x:
                h = known = 0
                continue
            if known == n:
                h = (h - seq[p - n] * top) % _MOD
            else:
                known += 1
            h = (h * _BASE + x) % _MOD
            if known == n:
                yield p - n + 1, h

    def matches(self, words: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal runs in common as (length, document start, item start)."""
        get = self.ids.get
        seq = [get(w, 0) for w in words]
        if len(seq) < self.size:
            return {}
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        reach: dict[tuple[int, int], int] = {}
        for p, h in self._hashes(seq):
            for k, q in self.at.get(h, ()):
                item = self.items[k][1]
                if reach.get((k, p - q), -1) > p or seq[p : p + self.size] != item[q : q + self.size]:
                    continue
                n = self.size
                while p + n < len(seq) and q + n < len(item) and seq[p + n] == item[q + n]:
                    n += 1
                reach[(k, p - q)] = p + n
                found[k].append((n, p, q))
        return found

    def tiles(self, words: list[str]) -> list[tuple[object, int, int, int, int]]:
        """(item, longest tile, number of tiles, tokens covered, item tokens)."""
        out = []
        for k, runs in self.matches(words).items():
            key, item = self.items[k]
            in_doc: set[int] = set()
            in_item: set[int] = set()
            queue = sorted(runs, key=lambda r: (-r[0], r[1], r[2]))
            longest = count = 0
            while queue:
                n, p, q = queue.pop(0)
                free = [j for j in range(n) if p + j not in in_doc and q + j not in in_item]
                if len(free) == n:
                    in_doc.update(range(p, p + n))
                    in_item.update(range(q, q + n))
                    longest, count = max(longest, n), count + 1
                    continue
                # what is left of a run that overlaps a tile goes back into the queue
                begin = None
                for j in [*free, n + 1]:
                    if begin is None:
                        begin = last = j
                    elif j == last + 1 and j < n:
                        last = j
                    else:
                        if last - begin + 1 >= self.size and begin < n:
                            queue.append((last - begin + 1, p + begin, q + begin))
                        begin = last = j
                queue.sort(key=lambda r: (-r[0], r[1], r[2]))
            out.append((key, longest, count, len(in_item), len(item)))
        return out


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items for the driver, a bounded number of characters at a time."""
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (BLOCK_CHARS // 2)))
    for k in range(parts):
        yield (items if parts == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)).collect()


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    question: str = "question", lang: str = "lang", dense_langs: tuple[str, ...] = ("zh",), min_run: int = 10, min_run_dense: int = 20,
) -> DataFrame:
    """``(doc_id, item_id, longest, tiles, covered, item_size)`` of each leak.

    A row for each document and item with a run of at least ``min_run`` tokens
    in common (words; letters and digits for items in ``dense_langs``).
    ``covered`` counts item tokens inside tiles. Null texts and items with
    fewer tokens leak nowhere; a null ``lang`` counts as spaced. Equal items
    are all reported. Rows repeated in either table repeat in the result.
    Without items or documents the result is empty.
    """
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, longest int, tiles int, covered int, item_size int"
    source = spread(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null"))
    asked = items.select(F.col(item_id).alias("item"), F.col(question).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang")).where("text is not null")
    sc = documents.sparkSession.sparkContext
    result = None
    for block in _blocks(asked):
        spaced = [(r["item"], r["text"]) for r in block if r["lang"] not in dense_langs]
        dense = [(r["item"], r["text"]) for r in block if r["lang"] in dense_langs]
        sent = sc.broadcast((spaced, dense))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            a, b = sent.value
            kinds = [s for s in (Seeds(a, False, min_run), Seeds(b, True, min_run_dense)) if s.items]
            for pdf in batches:
                rows = []
                for i, t in zip(pdf["id"], pdf["text"]):
                    ws = WORD.findall(t.lower())
                    for s in kinds:
                        rows += [(i, *tile) for tile in s.tiles(list("".join(ws)) if s.dense else ws)]
                yield pd.DataFrame(rows, columns=[doc_id, item_id, "longest", "tiles", "covered", "item_size"])

        part = source.mapInPandas(run, schema)
        result = part if result is None else result.unionByName(part)
    return result


def leak_report(leaks: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Which items leaked, into how many documents, and how much of them."""
    return leaks.groupBy(item_id).agg(
        F.countDistinct(doc_id).alias("documents"), F.max("longest").alias("longest"),
        F.max(F.col("covered") / F.col("item_size")).alias("best_coverage"),
    )
