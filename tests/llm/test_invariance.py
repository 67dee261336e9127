"""The training-data queries on rows in another order and other partitions."""

import pytest

from textmill.llm import queries


@pytest.mark.parametrize("name", ["p1_found", "p1_classes", "p2_packed", "p3_found", "p4_found", "p5_mixtures", "p6_found"])
def test_rows_stay_the_same(spark, tiny, tmp_path, name):
    tables = {"p1_found": "filter_results", "p2_packed": "conversations", "p3_found": "preference_pairs"}
    t = tables.get(name, "documents")
    spark.read.parquet(f"{tiny}/{t}.parquet").orderBy("source").repartition(7).write.parquet(f"{tmp_path}/{t}.parquet")
    for other in {"eval_items", "pack_targets", "mixture_targets", "documents"} - {t}:
        (tmp_path / f"{other}.parquet").symlink_to(f"{tiny}/{other}.parquet")
    run = lambda d: sorted(map(str, queries.queries()[name](spark, d).collect()))
    want = run(tiny)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run(str(tmp_path)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
