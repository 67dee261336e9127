"""The curation operators on streams of files.

Scores are stateless and run on a stream as they are. Deduplication keeps
state only as long as the watermark; statistics are tumbling windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.quality import Score
from textmill.operators.dedup import digest
from textmill.operators.filtering import evaluate


def with_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need a timestamp with zone; other kinds are cast."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def stream_dedupe(df: DataFrame, key_cols: list[str], time_col: str, horizon: str = "10 minutes") -> DataFrame:
    """The first row of each key within the horizon."""
    return with_time(df, time_col).withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(key_cols)


def stream_dedupe_text(df: DataFrame, text_col: str, time_col: str, horizon: str = "10 minutes") -> DataFrame:
    return stream_dedupe(df.withColumn("digest", digest(F.col(text_col))), ["digest"], time_col, horizon)


def stream_verdicts(df: DataFrame, text_col: str, scores: list[Score] | None = None) -> DataFrame:
    return evaluate(df, text_col, scores)


def windowed_stats(df: DataFrame, time_col: str, value_col: str, by: list[str], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count, sum and extremes of each tumbling window and group."""
    timed = with_time(df, time_col).withWatermark(time_col, lateness)
    return timed.groupBy(F.window(time_col, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"), F.min(value_col).alias("least"), F.max(value_col).alias("most")).select(F.col("w.start").alias("window_start"), *by, "n", "total", "least", "most")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, write Parquet, stop; gives what was written."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(path)
