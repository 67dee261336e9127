"""Mixtures: limits kept, shares met, draws the same however the rows lie."""

import pytest

from textmill.llm import mixture as mx
from textmill.llm import queries

TARGETS = "mixture_id string, source string, weight double, max_repeats double, budget_ratio double"


def test_water_fill():
    assert mx.water_fill({"a": 1, "b": 1}, {"a": 100, "b": 100}, 50) == {"a": 25, "b": 25}
    got = mx.water_fill({"a": 1, "b": 1, "c": 2}, {"a": 5, "b": 100, "c": 100}, 65)
    assert got == {"a": 5, "b": pytest.approx(20), "c": pytest.approx(40)}
    assert mx.water_fill({"a": 1, "b": 1}, {"a": 5, "b": 6}, 65) == {"a": 5, "b": 6}
    assert mx.water_fill({"a": 0, "b": 1}, {"a": 5, "b": 0}, 9) == {"a": 0, "b": 0} and mx.water_fill({}, {}, 3) == {}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"text number {i} of source " + "x " * (i % 13), " Big\t" if i % 2 else "big") for i in range(600)] + [(1000 + i, "some rare words here", "rare") for i in range(20)]
    rows += [(2000, None, "big"), (2001, "", "rare"), (2002, "no source", None), (2003, "blank", "  "), (2004, "other", "unused")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_limits_and_shares(spark, corpus):
    targets = spark.createDataFrame([("m", "BIG", 1.0, 2.0, 0.5), ("m", "rare", 1.0, 2.5, 0.5), ("m", "gap", 1.0, 9.0, 0.5), ("n", "rare", 1.0, 3.0, 3.0)], TARGETS)
    rep = {(r["mixture_id"], r["source"]): r for r in mx.mixture_report(corpus, targets).collect()}
    assert rep[("m", "gap")]["drawn"] == 0 and rep[("m", "gap")]["limited"] and rep[("m", "gap")]["passes"] is None
    r = rep[("m", "rare")]
    assert r["limited"] and r["passes"] <= 2.5 and r["most_repeats"] == 3
    assert rep[("n", "rare")]["passes"] == 3.0
    total = sum(x["drawn"] for (m, _), x in rep.items() if m == "m")
    assert abs(total - rep[("m", "big")]["budget"]) <= 40 and sum(x["share"] for (m, _), x in rep.items() if m == "m") == pytest.approx(1)
    draw = mx.mix_sources(corpus, targets)
    got = sorted(map(tuple, draw.collect()))
    assert got == sorted(map(tuple, mx.mix_sources(corpus.repartition(7), targets).collect()))
    assert got != sorted(map(tuple, mx.mix_sources(corpus, targets, seed=5).collect()))
    assert all(r[-1] >= 1 and r[1] in ("big", "rare") for r in got)


def test_draw_is_the_hash_prefix(spark, corpus):
    """The fraction is what a sort of the whole source would give."""
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([("m", "big", 1.0, 1.0, 0.37)], TARGETS)
    got = {r["doc_id"] for r in mx.mix_sources(corpus, targets, seed=17).collect()}
    big = corpus.where("lower(trim(replace(source, '\t', ''))) = 'big' and text is not null and text <> ''")
    counted = {r["doc_id"]: r["tokens"] for r in mx.count_tokens(big.select("doc_id", "text")).collect()}
    rows = big.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit("m"), F.col("doc_id")), 52).alias("s"), F.xxhash64(F.lit(17), F.lit("m"), F.col("doc_id")).alias("o")).collect()
    left, want = int(0.37 * sum(counted.values()) + 1e-6), set()
    for r in sorted(rows, key=lambda r: (r["s"], r["o"])):
        if counted[r["doc_id"]] > left:
            break
        left -= counted[r["doc_id"]]
        want.add(r["doc_id"])
    assert got == want


def test_edges(spark, corpus):
    targets = spark.createDataFrame([("m", "big", 1.0, 1.0, 0.5), (None, "big", 1.0, 1.0, 0.5), ("k", None, 1.0, 1.0, 0.5), ("z", "big", None, None, None)], TARGETS)
    assert {r["mixture_id"] for r in mx.mix_sources(corpus, targets).select("mixture_id").distinct().collect()} == {"m"}
    assert mx.mix_sources(corpus, targets.limit(0)).count() == 0 and mx.mix_sources(corpus.limit(0), targets).count() == 0
    long = spark.createDataFrame([(1, "word " * 60_000, "big"), (2, "y" * 50_000, "big")], "doc_id long, text string, source string")
    assert mx.mix_sources(long, spark.createDataFrame([("m", "big", 1.0, 2.0, 2.0)], TARGETS)).count() == 2


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world hello"), (2, "<|endoftext|>"), (3, "漢字")], "i long, text string")
    got = {r["i"]: r["tokens"] for r in mx.count_tokens(df).collect()}
    assert got[1] == 3 and got[2] > 1 and got[3] >= 2


def test_query(spark, tiny):
    for r in queries.p5_shares(spark, tiny).collect():
        assert r["passes"] is None or r["passes"] >= 0
        assert (r["share"] or 0) <= 1
