"""A curation pipeline from the data section of a run configuration.

The keys that data mutations set are honoured here: ``min_len``, ``max_len``,
``dedupe``, ``conversation_format``, ``curriculum`` and ``constitution``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.operators import chat, curriculum, dedup, filtering
from textmill.sources import jsonl

KEYS = {"min_len", "max_len", "dedupe", "conversation_format", "curriculum"}


def curate(df: DataFrame, data: dict, id_col: str, text_col: str = "text", messages_col: str = "messages") -> DataFrame:
    """``(id_col, text[, stage, rank])`` as the configuration wants it.

    With a conversation format the text is rendered from the messages. Hard
    length limits come first, then copies go, then stages are set. Keys that
    are absent or null change nothing; unknown ones are an error.
    """
    unknown = {k for k, v in data.items() if v is not None} - KEYS - {"constitution", "dataset", "batch_size", "block_size", "sources"}
    if unknown:
        raise ValueError(f"unknown data keys: {sorted(unknown)}")
    if name := data.get("conversation_format"):
        out = df.select(id_col, chat.FORMATS[name](chat.known(F.col(messages_col))).alias("text"))
    else:
        out = df.select(id_col, F.col(text_col).alias("text"))
    if data.get("min_len") is not None or data.get("max_len") is not None:
        out = filtering.hard_length(out, "text", data.get("min_len") or 0, data.get("max_len"))
    if data.get("dedupe"):
        out = dedup.dedupe(out, "text", id_col)
    plan = data.get("curriculum") or {}
    if plan.get("enabled"):
        if plan.get("strategy", "length") != "length":
            raise ValueError("only lengths are known here; order by a score column with curriculum.order_by_difficulty")
        ranked = curriculum.order_by_difficulty(out, F.size(tx.words(F.col("text"))), id_col)
        return curriculum.schedule(ranked, ranked.count(), plan.get("num_stages", 4), plan.get("schedule", "linear")).select(id_col, "text", "stage", "rank")
    return out


def preference_source(spark: SparkSession, data: dict) -> DataFrame | None:
    """The preference pairs a configuration injects, if it does."""
    plan = data.get("constitution") or {}
    return jsonl.read(spark, "constitution", plan["path"]).drop("_corrupt_record") if plan.get("enabled") else None
