"""Next fit in ranges against a plain fold."""

import random

import pytest

from textmill.operators.packing import next_fit


def fold(items, room, gap, first_counts_gap):
    out, cur, n, used = [], 0, 0, 0
    for pos, size in items:
        fresh = size + gap
        if n and used + size + gap > room:
            cur, n, used = cur + 1, 0, 0
            fresh = size if first_counts_gap else size + gap
        out.append((cur, n, pos, used))
        used, n = used + fresh, n + 1
    return out


@pytest.mark.parametrize("gap,first", [(0, False), (2, False), (2, True)])
@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("room,top", [(30, 12), (10, 25), (400, 5)])
def test_equals_the_fold(spark, gap, first, longest, room, top):
    r = random.Random(room + gap)
    items = [(i, r.choice([0, 1, r.randrange(top + 1), top])) for i in range(300)]
    df = spark.createDataFrame(items, "pos long, size long")
    order = sorted(items, key=lambda t: (-t[1], t[0])) if longest else items
    want = sorted(fold(order, room, gap, first))
    for parts in (1, 9):
        got = next_fit(df, room, longest_first=longest, gap=gap, first_counts_gap=first, parts=parts)
        assert sorted((x["bin"], x["slot"], x["pos"], x["start"]) for x in got.collect()) == want


def test_no_task_has_all_rows(spark):
    df = spark.range(4000).selectExpr("id as pos", "id % 7 + 1 as size")
    got = next_fit(df, 50, parts=8)
    assert got.count() == 4000
    assert next_fit(df.limit(0), 50).count() == 0


def test_shards_pack_their_own(spark):
    df = spark.range(200).selectExpr("id as pos", "id % 5 + 1 as size")
    rows = next_fit(df, 20, shards=3, parts=5).collect()
    sizes = {i: i % 5 + 1 for i in range(200)}
    for shard in range(3):
        mine = [x for x in rows if x["shard"] == shard]
        items = sorted((x["pos"], sizes[x["pos"]]) for x in mine)
        assert sorted((x["bin"], x["slot"], x["pos"], x["start"]) for x in mine) == sorted(fold(items, 20, 0, False))
