"""Chat transcripts: parsing, templates, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.packing import next_fit

# Template parts.
ALPACA_HEAD = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
ROLE_NAMES = {"human": "user", "gpt": "assistant"}

MESSAGES = "array<struct<role:string,content:string>>"
_SHAREGPT = "conversations array<struct<`from`:string,value:string>>"
_OPENAI = "messages array<struct<role:string,content:string>>"


def _messages(items: Column, role: str, content: str, no_role: str) -> Column:
    kept = F.transform(items, lambda m: F.struct(F.coalesce(m[role], F.lit(no_role)).alias("role"), F.coalesce(m[content], F.lit("")).alias("content")))
    return F.coalesce(kept, F.array().cast(MESSAGES))


def from_sharegpt(json: Column) -> Column:
    """Messages of a ShareGPT record; no role is ``unknown``, no list is empty."""
    return _messages(F.from_json(json, _SHAREGPT)["conversations"], "from", "value", "unknown")


def from_openai(json: Column) -> Column:
    """Messages of an OpenAI record; no role is ``user``."""
    return _messages(F.from_json(json, _OPENAI)["messages"], "role", "content", "user")


def known(messages: Column, no_role: str = "unknown") -> Column:
    """Messages of a table, null parts given their defaults and null entries left out."""
    return _messages(F.filter(messages, lambda m: m.isNotNull()), "role", "content", no_role)


def role_name(role: Column) -> Column:
    out = role
    for old, new in ROLE_NAMES.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def chatml(messages: Column) -> Column:
    turn = lambda m: F.concat(F.lit("<|im_start|>"), role_name(m["role"]), F.lit("\n"), m["content"], F.lit("<|im_end|>"))
    return F.array_join(F.transform(messages, turn), "\n")


def llama3(messages: Column) -> Column:
    turn = lambda m: F.concat(F.lit("<|start_header_id|>"), role_name(m["role"]), F.lit("<|end_header_id|>\n\n"), m["content"], F.lit("<|eot_id|>"))
    return F.concat(F.lit("<|begin_of_text|>"), F.array_join(F.transform(messages, turn), ""))


def alpaca(messages: Column) -> Column:
    """The first two messages, whatever their roles; fewer give an empty text."""
    body = F.concat(F.lit(ALPACA_HEAD + "### Instruction:\n"), F.get(messages, F.lit(0))["content"], F.lit("\n\n### Response:\n"), F.get(messages, F.lit(1))["content"])
    return F.when(F.size(messages) < 2, "").otherwise(body)


FORMATS = {"chatml": chatml, "llama3": llama3, "alpaca": alpaca}


def pack_conversations(df: DataFrame, order_col: str, text_col: str, max_length: int = 2048, separator: str = "\n\n", shards: int = 1) -> DataFrame:
    """``(shard, pack, length, items, text)``: rendered conversations in packs.

    In the order of ``order_col``, one pack is open at a time and closed when
    the next one and a separator don't fit. The first pack counts a separator
    for each conversation, later ones not for their first. Longer ones are
    alone in a pack, whole. Null texts are left out. With one shard the order
    is total; more shards pack alike side by side. Only ids and lengths go
    through the packing, texts are joined to it afterwards.
    """
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(order_col).alias("pos"), F.col(text_col).alias("text"))
    placed = next_fit(rows.select("pos", F.length("text").alias("size")), max_length, shards=shards, gap=len(separator), first_counts_gap=True)
    joined = rows.join(placed, "pos").groupBy("shard", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "text"))), lambda x: x["text"]), separator).alias("text"), F.count(F.lit(1)).alias("items"))
    return joined.select("shard", F.col("bin").alias("pack"), F.length("text").alias("length"), "items", "text")
