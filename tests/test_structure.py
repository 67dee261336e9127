"""What may import what, and what a stream must equal."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textmill.operators import filtering
from textmill.streaming import curation

ROOT = Path(__file__).resolve().parents[1]


def test_core_does_not_import_the_subpackage():
    for f in [*(ROOT / "textmill").rglob("*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("textmill.llm") for n in names), f


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "documents", "passed", "kept"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_a_dependency(monkeypatch):
    """Core queries stay when the subpackage, or something it needs, is missing."""
    import importlib

    import __spark_entry__ as e

    def missing(name, *args):
        raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")

    monkeypatch.setattr(importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="xxhash"):
        names = set(e.queries())
    assert "q_filter_pipeline" in names and not any(n.startswith("p") for n in names)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    from textmill import runtime

    class Conf:
        def get(self, key, default):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_scopes_delete_their_own_tables(spark):
    from textmill import runtime

    outer = runtime.materialize(spark.range(3), "outer")
    with runtime.scope(spark):
        inner = runtime.materialize(spark.range(4), "inner")
        with runtime.scope(spark):
            deepest = runtime.materialize(spark.range(2), "deepest")
            assert deepest.count() == 2
        assert inner.count() == 4
    assert outer.count() == 3
    with pytest.raises(Exception):
        runtime.materialize(spark.read.parquet(*inner.inputFiles()), "gone")
    assert runtime.discard_tables(spark) >= 1


def test_spread_runs_nothing(spark):
    from textmill import runtime

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "")
    runtime.spread(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert not tracker.getJobIdsForGroup("spread")
    spark.sparkContext.setJobGroup("", "")


def test_stream_verdicts_equal_batch(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = curation.stream_verdicts(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), "text").select("doc_id", "passed")
    got = curation.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, filtering.evaluate(docs).select("doc_id", "passed").collect()))


def test_stream_dedupe_text(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "i int, text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i")))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    s = curation.stream_dedupe_text(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "text", "ts", "1 day")
    assert curation.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "state")).select("text").distinct().count() == 7


def test_written_tables(spark, monkeypatch):
    from textmill import runtime

    before = spark.conf.get("spark.checkpoint.dir", None)
    df = runtime.materialize(spark.range(5), "t")
    assert df.count() == 5 and (before is None or runtime.shared_dir(spark) == before.rstrip("/"))
    assert runtime.spread(spark.range(3).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert runtime.discard_tables(spark) >= 1
