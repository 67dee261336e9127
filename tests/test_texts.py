"""Scores against plain restatements, on texts chosen to be awkward."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.functions import quality as ql
from textmill.functions import text as tx
from textmill.operators import filtering

EDGE = ["", " ", "a", "aaaaaaaaa", "abcdefghij", "the cat and the dog is on it", "a b c a b c a b c", "x" * 5000, "one\x85two\xa0three\x1cfour", "İstanbul is THE", "nul\x00here and there", "é́ combining", "😀 😀 the of", "http://a.b/c www.x.y", "see https://long.example/" + "p" * 80, "def f(): return if else", "\n\n\t", "word", "the the the the", "漢字かな交じり文です。"]


def words(t):
    return t.split()


def repetition(t):
    if not t:
        return 0.0
    ws, parts = words(t), []
    if len(ws) > 1:
        parts.append(len(set(ws)) / len(ws))
    if len(t) > 1:
        parts.append((1 + sum(a != b for a, b in zip(t, t[1:]))) / len(t))
    for n in (2, 3, 4):
        if len(ws) >= n:
            grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
            parts.append(len(set(grams)) / len(grams))
    return min(parts) if parts else 1.0


def chars(t):
    if not t:
        return 0.0
    n = len(t)
    return min(sum(c.isprintable() or c in "\n\t\r" for c in t) / n, 1.5 * sum(c.isalnum() or c.isspace() for c in t) / n, 1 - t.count("\0") / n)


def language(t):
    ws = set(words(t.lower()))
    return max(min(1.0, len(ws & set(v)) / 5) for v in ql.COMMON_WORDS.values())


def perplexity(t):
    if len(t) < 10:
        return 0.5
    h = -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t.lower()).values())
    return 0.3 if h < 1 else max(0.0, 1 - (h - 5) / 5) if h > 5 else 1.0


def links(t):
    if not t:
        return 1.0
    r = sum(len(m) for m in re.findall(r"https?://\S+|www\.\S+", t)) / len(t)
    return 1.0 if r <= 0.3 else max(0.0, 1 - (r - 0.3) / 0.7)


def length(t):
    return len(t) / 50 if len(t) < 50 else 100_000 / len(t) if len(t) > 100_000 else 1.0


PLAIN = {"length": length, "repetition": repetition, "char_distribution": chars, "language": language, "perplexity": perplexity, "url_density": links}


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(list(enumerate(EDGE)) + [(99, None)], "i int, text string")
    return {r["i"]: r for r in filtering.evaluate(df).collect()}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_score(scored, name):
    for i, t in enumerate(EDGE):
        assert scored[i][f"score_{name}"] == pytest.approx(PLAIN[name](t), abs=1e-9), (name, t[:30])


def test_null_text(scored):
    r = scored[99]
    assert r["failed_filters"] == ["null_text"] and not r["passed"] and r["score_length"] is None


def test_words_and_strip(spark):
    df = spark.createDataFrame([(t,) for t in EDGE], "t string")
    for r in df.select("t", tx.words(F.col("t")).alias("w"), tx.strip(F.col("t")).alias("s")).collect():
        assert r["w"] == r["t"].split() and r["s"] == r["t"].strip()


def test_filter_samples_and_stats(spark):
    df = spark.createDataFrame([(1, "the cat and the dog is on it, that was for you to have"), (2, "x"), (3, None)], "i int, text string")
    kept, stats = filtering.filter_samples(df)
    assert [r["i"] for r in kept.collect()] == [1]
    s = stats.first()
    assert (s["total"], s["passed"], s["failed"], s["rejected_length"]) == (3, 1, 2, 1)
    empty = filtering.stats(filtering.evaluate(df.limit(0)), ["length"]).first()
    assert (empty["total"], empty["passed"], empty["pass_rate"]) == (0, 0, 0.0)


def test_scores_need_names_and_empty_list_is_default(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        filtering.evaluate(df, "text", [ql.length(), ql.length()])
    assert "score_perplexity" in filtering.evaluate(df, "text", []).columns


def test_hard_length(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abc",), ("abcd",), (None,)], "t string")
    assert [r["t"] for r in filtering.hard_length(df, "t", 2, 3).collect()] == ["ab", "abc"]


def test_decision_log(spark):
    df = filtering.evaluate(spark.createDataFrame([(1, "abc")], "i int, text string"))
    r = filtering.results(df, "i", "text", ["length", "language"]).first()
    assert r["scores"]["length"] == pytest.approx(0.06) and "language" in r["failed_filters"]
