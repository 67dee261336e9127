"""Results don't depend on how the rows lie or on the number of partitions."""

import pytest

from textmill.plans import catalogue

NAMES = ["q_exact_dedup", "q_minhash_keep", "q_pack_sequences", "q_pack_conversations", "q_curriculum_linear", "q_mixture_schedule", "q_best_of_n", "q_metrics_last", "q_sweep_rank", "q_stream_windows"]


@pytest.fixture(scope="module")
def scattered(spark, tiny, tmp_path_factory):
    """The tables in another order and in several files."""
    home = tmp_path_factory.mktemp("scattered")
    for t in ("documents", "conversations", "preference_pairs", "metrics_log", "train_runs", "events", "filter_results"):
        spark.read.parquet(f"{tiny}/{t}.parquet").orderBy("ingested_at" if t == "metrics_log" else "source" if t == "documents" else spark.read.parquet(f"{tiny}/{t}.parquet").columns[1]).repartition(5).write.parquet(f"{home}/{t}.parquet")
    return str(home)


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay_the_same(spark, tiny, scattered, name):
    run = lambda d: sorted(map(str, catalogue.queries()[name](spark, d).collect()))
    want = run(tiny)
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert run(scattered) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
