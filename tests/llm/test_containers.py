"""Containers: nothing lost, nothing split, nothing over the edge, little unused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import containers as co
from textmill.llm import queries


def filled(spark, sizes, targets):
    items = spark.createDataFrame(list(sizes), "i long, n long")
    t = spark.createDataFrame(targets, "pack_id string, max_length long, joiner_length long")
    return [r.asDict() for r in co.fill_containers(items, t, "i", "n").collect()]


def check(rows, sizes, targets):
    for name, most, joiner in targets:
        own = [r for r in rows if r["pack_id"] == name]
        by_item, by_container = {}, {}
        for r in own:
            by_item.setdefault(r["i"], []).append(r)
            by_container.setdefault(r["container"], []).append(r)
        assert set(by_item) == {i for i, _ in sizes}
        for i, n in dict(sizes).items():
            pieces = sorted(by_item[i], key=lambda r: r["piece"])
            assert len(pieces) == max(1, -(-n // most))
            assert [p["piece_start"] for p in pieces] == [k * most for k in range(len(pieces))] and sum(p["piece_length"] for p in pieces) == n
        for c in by_container.values():
            assert sorted(r["position"] for r in c) == list(range(len(c)))
            assert sum(r["piece_length"] for r in c) + joiner * (len(c) - 1) <= most


def test_fill(spark):
    r = np.random.default_rng(2)
    sizes = [(i, int(n)) for i, n in enumerate(np.clip(r.lognormal(5.5, 1, 3000), 1, 9000))]
    targets = [("a", 1000, 2), ("b", 4000, 0), ("c", 200, 2)]
    rows = filled(spark, sizes, targets)
    check(rows, sizes, targets)
    for name, most, joiner in targets:
        n = len({r["container"] for r in rows if r["pack_id"] == name})
        assert n <= 1.03 * sum(s for _, s in sizes) / most + 1


def test_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_ITEMS", 100)
    sizes = [(i, 1 + i % 97) for i in range(1000)]
    check(filled(spark, sizes, [("a", 200, 1)]), sizes, [("a", 200, 1)])


def test_edges(spark):
    sizes = [(1, 10), (2, 10), (3, 25), (4, 1)]
    rows = filled(spark, [*sizes, (2, 10), (5, 0), (6, None), (None, 4), (7, -3)], [("a", 10, 2), ("z", 0, 1), ("n", None, 1), ("j", 30, None)])
    check(rows, sizes, [("a", 10, 2), ("j", 30, 0)])
    assert {r["pack_id"] for r in rows} == {"a", "j"}
    assert filled(spark, [], [("a", 10, 0)]) == [] and filled(spark, sizes, []) == []


def test_chatml_size(spark):
    from textmill.operators.chat import chatml, known

    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("messages", co.chatml_size().alias("n"), F.length(chatml(known(F.col("messages")))).alias("m"))
    for r in c.collect():
        assert r["n"] == (r["m"] if r["messages"] else None)


def test_nnls_against_conditions():
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = np.abs(r.normal(size=(15, 40))), r.normal(size=15)
        x = co.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and np.allclose(g[x > 0], 0, atol=1e-6)


def test_patterns():
    got = co.patterns(12)
    assert len(got) == len(set(got)) == 1 + 6 + 12 and all(sum(p) == 12 and list(p) == sorted(p, reverse=True) for p in got)


def test_report(spark, tiny):
    for r in queries.p2_unused(spark, tiny).collect():
        most = r["room"] // r["containers"]
        assert 0 <= r["unused_share"] and r["containers"] <= -(-r["filled"] // most) + 2
        assert r["unused_share"] == pytest.approx(1 - (r["filled"] + 2 * (r["items"] - r["containers"])) / r["room"])
