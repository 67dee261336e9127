"""JSON-lines files of the pipeline with explicit schemas.

Blank lines are skipped; lines that don't parse come as ``_corrupt_record``.
A missing path is an error of the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "constitution": "prompt string, chosen string, rejected string, metadata map<string,string>",
    "preferences": "prompt string, chosen string, rejected string, chosen_score double, rejected_score double",
    "instructions": "instruction string, response string",
    "math": "problem string, solution string, answer string",
    "gsm8k": "question string, answer string",
    "mmlu": "question string, choices array<string>, answer string",
    "humaneval": "prompt string, test string, entry_point string",
    "metrics": "iter long, train_loss double, val_loss double, lr double, batch_size long, gns double",
    "sharegpt": "conversations array<struct<`from`:string,value:string>>",
    "openai": "messages array<struct<role:string,content:string>>",
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    schema = SCHEMAS[kind] + ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_stream(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The same files as they arrive."""
    return spark.readStream.schema(SCHEMAS[kind]).json(path)


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists") -> None:
    """The columns of the kind; null scores are written, null metadata is not."""
    names = [c.strip("` ").split()[0].strip("`") for c in SCHEMAS[kind].replace("array<struct<`from`:string,value:string>>", "x").replace("array<struct<role:string,content:string>>", "x").split(", ")]
    df.select(*[c for c in names if c in df.columns]).write.mode(mode).option("ignoreNullFields", str(kind not in ("preferences",)).lower()).json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
