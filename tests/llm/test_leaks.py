"""String tiling against brute force and on passages in another order."""

import random
import re

import pytest

from tests.oracle import compare
from textmill.llm import leaks as lk
from textmill.llm import oracles, queries

WORD = re.compile(r"[^\W_]+")


def brute(docs, items):
    hits = set()
    for i, q, lang in items:
        if not q:
            continue
        ws, n = (list("".join(WORD.findall(q.lower()))), 20) if lang == "zh" else (WORD.findall(q.lower()), 10)
        grams = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
        for d, t in docs:
            if t:
                us = WORD.findall(t.lower())
                us = list("".join(us)) if lang == "zh" else us
                if any(tuple(us[k : k + n]) in grams for k in range(len(us) - n + 1)):
                    hits.add((d, i))
    return hits


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/eval_items.parquet").where("split = 'test'").select("item_id", "question", "lang").collect()]
    got = {tuple(r) for r in queries.p4_found(spark, folder).collect()}
    assert got == brute(docs, items) != set()


def test_query_equals_its_sql(spark, tiny):
    compare(spark, tiny, queries.p4_found, oracles.P4_FOUND)


def test_random_texts(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(r.randrange(8, 30))), None) for k in range(20)]
    docs = [(k, " ".join([word() for _ in range(20)] + items[k % 20][1].split()[: r.randrange(5, 20)] + [word() for _ in range(9)])) for k in range(60)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, lang string")
    got = {(x["doc_id"], x["item_id"]) for x in lk.leaked_items(df, it).collect()}
    assert got == brute(docs, items)


def test_tiles_of_reordered_passages():
    s = lk.Seeds([("q", "one two three four five six seven eight nine ten")], False, 3)
    [(key, longest, tiles, covered, size)] = s.tiles("six seven eight nine ten and then one two three four five".split())
    assert (key, longest, tiles, covered, size) == ("q", 5, 2, 10, 10)
    [(_, longest, tiles, covered, _)] = s.tiles(("one two three four five " * 3).split())
    assert (longest, tiles, covered) == (5, 1, 5)


def test_edges(spark):
    q = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    docs = [(1, None), (2, ""), (3, f"x, {q.upper()}!"), (3, f"x, {q.upper()}!"), (4, q.replace(" ", "_") + " z" * 50_000), (None, q)]
    items = [(1, q, "en"), (2, q, None), (3, "too short", "en"), (4, None, "zh"), (5, "", "zh")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as id")
    it = spark.createDataFrame(items, "item_id long, question string, lang string")
    rows = [(r["doc_id"], r["item_id"], r["longest"]) for r in lk.leaked_items(df, it).collect()]
    assert sorted(rows, key=str) == sorted([(3, 1, 10), (3, 2, 10)] * 2 + [(4, 1, 10), (4, 2, 10), (None, 1, 10), (None, 2, 10)], key=str)
    assert lk.leaked_items(df, it.limit(0)).count() == 0 and lk.leaked_items(df.limit(0), it).count() == 0
    report = {r["item_id"]: r["documents"] for r in lk.leak_report(lk.leaked_items(df, it)).collect()}
    assert report == {1: 2, 2: 2}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_CHARS", 100)
    qs = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(9)]
    df = spark.createDataFrame([(k, q) for k, q in enumerate(qs)], "doc_id long, text string")
    it = spark.createDataFrame([(k, q, None) for k, q in enumerate(qs)], "item_id long, question string, lang string")
    assert sorted((r["doc_id"], r["item_id"]) for r in lk.leaked_items(df, it).collect()) == [(k, k) for k in range(9)]


@pytest.mark.parametrize("min_run,want", [(4, {("d", "i")}), (6, set())])
def test_dense_items(spark, min_run, want):
    df = spark.createDataFrame([("d", "前文：今天天气，很好。")], "doc_id string, text string")
    it = spark.createDataFrame([("i", "今天天气很冷", "zh")], "item_id string, question string, lang string")
    assert {(r["doc_id"], r["item_id"]) for r in lk.leaked_items(df, it, min_run_dense=min_run).collect()} == want
