"""Queries over transcripts, packing, order, windows, schedules, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.operators import bpe, chat, curriculum, mixing, packing, tokens
from textmill.plans import pipeline
from textmill.plans.curation import DIGEST, S, WORDS, documents

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PACK, ROW, STAGES = 16_384, 2048, 4


def _chats(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "messages").distinct()
    return rows.withColumn("messages", chat.known(F.col("messages")))


def _rendered(name: str):
    return lambda spark, d: _chats(spark, d).select("conv_id", chat.FORMATS[name](F.col("messages")).alias("rendered"))


def q_conversation_json(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts through both JSON layouts: turns and roles that come back."""
    c = _chats(spark, d)
    share = F.to_json(F.struct(F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations")))
    both = c.select("conv_id", chat.from_sharegpt(share).alias("a"), chat.from_openai(F.to_json(F.struct("messages"))).alias("b"))
    return both.select("conv_id", F.size("a").cast("long").alias("turns"), F.array_join(F.transform("b", lambda m: m["role"]), ",").alias("roles"))


def q_pack_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = _chats(spark, d).where(F.size("messages") > 0).select("conv_id", chat.chatml(F.col("messages")).alias("t"))
    return chat.pack_conversations(c, "conv_id", "t", PACK).select("pack", F.col("length").cast("long").alias("length"), "items")


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    """The lengths of a document's words stand for its tokens."""
    return documents(spark, d).where("text is not null").select("doc_id", F.transform(tx.words(F.col("text")), lambda w: F.length(w)).alias("tokens"))


def q_pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_sequences(_sequences(spark, d), "doc_id", "tokens", ROW, eos=1)
    return packed.select("bin", F.col("used").cast("long").alias("used"), F.col("truncated").cast("long").alias("truncated"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


def q_pack_efficiency(spark: SparkSession, d: str) -> DataFrame:
    seq = _sequences(spark, d)
    e = packing.packing_efficiency(seq, "tokens", packing.pack_sequences(seq, "doc_id", "tokens", ROW, eos=1), ROW)
    return e.select("num_sequences", "num_packed", "total_tokens", *[F.round(c, 6).alias(c) for c in ("efficiency", "waste", "fill")])


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.order_by_difficulty(_lengths(spark, d), F.col("length"), "doc_id").drop("length")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """What a rank needs; the tokens stay where they are."""
    return _sequences(spark, d).select("doc_id", curriculum.length_score(F.col("tokens")).alias("length"))


def _staged(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        total = documents(spark, d).where("text is not null").count()
        return curriculum.schedule(_ranked(spark, d), total, STAGES, kind).select("stage", "rank", "doc_id", "difficulty")

    return query


def q_hardest_first(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.order_by_difficulty(_lengths(spark, d), F.col("length"), "doc_id", reverse=True).select("rank", "doc_id")


def q_stage_for_epoch(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 100).alias("epoch"))
    return e.select("event_id", curriculum.stage_for_epoch(F.col("epoch"), F.lit(100), STAGES).alias("stage"))


def q_token_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _sequences(spark, d).select("doc_id", F.explode(tokens.windows(F.col("tokens"), 16)).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.get("w.x", F.lit(0)) * 31 + F.get("w.y", F.lit(15))).cast("long").alias("checksum"))


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("pos"), F.col("user_id").cast("int").alias("token"))
    w = tokens.stream_windows(e, 8, shard=1000)
    return w.select("idx", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    s = documents(spark, d).select(F.coalesce("lang", F.lit("none")).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    return s.select(F.col("lang").alias("ds_idx"), "size", (F.length("lang") * 1.5).alias("weight"))


def q_mixture_schedule(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_schedule(_sources(spark, d))


def q_configured_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Limits, copies and stages from one configuration."""
    data = {"min_len": 100, "max_len": 3000, "dedupe": True, "curriculum": {"enabled": True, "strategy": "length", "schedule": "step", "num_stages": 5}}
    return pipeline.curate(documents(spark, d), data, "doc_id").groupBy("stage").agg(F.count(F.lit(1)).alias("documents"), F.sum("doc_id").alias("checksum"))


def q_replacement_draws(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    ranked = curriculum.global_rank(e, [F.asc("event_id")])
    return mixing.with_replacement(ranked, "rank", e.count(), 5000, seed=3).select("draw", "event_id")


def q_bpe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(documents(spark, d).where("text is not null").select(bpe.byte_ids(F.col("text")).alias("ids")), "ids")


def q_bpe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    merges = bpe.merges_of_ranks(spark, RANKS)
    ids = bpe.encode(documents(spark, d).select("doc_id", "text"), "text", merges, order="rank")
    back = bpe.decode(ids, "ids", merges, out_col="back")
    return back.select("doc_id", (F.size("ids") <= F.octet_length("text")).alias("no_longer"), F.octet_length("text").alias("n_bytes"), "unknown_ids", (F.col("back").eqNullSafe(F.col("text"))).alias("same"))


ROLE = "CASE coalesce(m.role, 'unknown') WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.role, 'unknown') END"
C = "WITH c AS (SELECT DISTINCT conv_id, list_filter(coalesce(messages, []), lambda m: m IS NOT NULL) AS messages FROM conversations)"
CHATML = f"coalesce(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || {ROLE} || chr(10) || coalesce(m.content, '') || '<|im_end|>'), chr(10)), '')"
SEQ = f"s AS (SELECT doc_id, list_transform({WORDS}, lambda w: length(w)) AS t FROM documents WHERE text IS NOT NULL)"
FOLD = f"""WITH RECURSIVE {SEQ}, o AS (SELECT row_number() OVER (ORDER BY len(t) DESC, doc_id) AS i, len(t) + 1 AS n, list_sum(t) AS s, t FROM s),
f(i, bin, used) AS (SELECT i, 0, n FROM o WHERE i = 1 UNION ALL
  SELECT o.i, CASE WHEN f.used + o.n > {ROW} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + o.n > {ROW} THEN o.n ELSE f.used + o.n END FROM f JOIN o ON o.i = f.i + 1),
b AS (SELECT f.bin, f.i, o.n, list_append(o.t, 1) AS t FROM f JOIN o USING (i)),
g AS (SELECT bin, flatten(list(t ORDER BY i)) AS t FROM b GROUP BY bin)"""
RANKED = f"WITH {SEQ}, r AS (SELECT doc_id, len(t)::DOUBLE AS difficulty, row_number() OVER (ORDER BY len(t), doc_id) - 1 AS rank, count(*) OVER () AS n FROM s)"
SRC = "WITH z AS (SELECT coalesce(lang, 'none') AS ds_idx, count(*) AS size, length(coalesce(lang, 'none')) * 1.5::DOUBLE AS weight FROM documents GROUP BY 1)"

QUERIES = {
    "q_chatml": _rendered("chatml"), "q_llama3": _rendered("llama3"), "q_alpaca": _rendered("alpaca"), "q_conversation_json": q_conversation_json, "q_pack_conversations": q_pack_conversations,
    "q_pack_sequences": q_pack_sequences, "q_pack_efficiency": q_pack_efficiency, "q_curriculum_linear": _staged("linear"), "q_curriculum_step": _staged("step"), "q_hardest_first": q_hardest_first,
    "q_stage_for_epoch": q_stage_for_epoch, "q_token_windows": q_token_windows, "q_stream_windows": q_stream_windows, "q_mixture_schedule": q_mixture_schedule, "q_configured_pipeline": q_configured_pipeline, "q_replacement_draws": q_replacement_draws, "q_bpe_pairs": q_bpe_pairs, "q_bpe_roundtrip": q_bpe_roundtrip,
}
ORACLES = {
    "q_bpe_roundtrip": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE true END AS no_longer, strlen(text) AS n_bytes, CASE WHEN text IS NOT NULL THEN 0 END AS unknown_ids, true AS same FROM documents",
    "q_chatml": C + f" SELECT conv_id, {CHATML} AS rendered FROM c",
    "q_llama3": C + f""" SELECT conv_id, '<|begin_of_text|>' || coalesce(array_to_string(list_transform(messages, lambda m: '<|start_header_id|>' || {ROLE} || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(m.content, '') || '<|eot_id|>'), ''), '') AS rendered FROM c""",
    "q_alpaca": C + f""" SELECT conv_id, CASE WHEN len(messages) < 2 THEN '' ELSE '{chat.ALPACA_HEAD.strip()}' || chr(10) || chr(10) || '### Instruction:' || chr(10) || coalesce(messages[1].content, '') || chr(10) || chr(10) || '### Response:' || chr(10) || coalesce(messages[2].content, '') END AS rendered FROM c""",
    "q_conversation_json": C + " SELECT conv_id, len(messages) AS turns, coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.role, 'unknown')), ','), '') AS roles FROM c",
    "q_pack_conversations": C.replace("WITH c", "WITH RECURSIVE c") + f""", o AS (SELECT row_number() OVER (ORDER BY conv_id) AS i, length({CHATML}) AS n FROM c WHERE len(messages) > 0),
f(i, pack, used) AS (SELECT i, 0, n + 2 FROM o WHERE i = 1 UNION ALL
  SELECT o.i, CASE WHEN f.used + o.n + 2 > {PACK} THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.used + o.n + 2 > {PACK} THEN o.n ELSE f.used + o.n + 2 END FROM f JOIN o ON o.i = f.i + 1)
SELECT f.pack::BIGINT AS pack, (sum(o.n) + 2 * (count(*) - 1))::BIGINT AS length, count(*) AS items FROM f JOIN o USING (i) GROUP BY f.pack""",
    "q_pack_sequences": FOLD + f" SELECT bin::BIGINT AS bin, least(len(t), {ROW}) AS used, greatest(len(t) - {ROW}, 0) AS truncated, coalesce(list_sum(t[1:{ROW}]), 0)::BIGINT AS checksum FROM g",
    "q_pack_efficiency": FOLD + f""", k AS (SELECT (SELECT count(*) FROM s) AS num_sequences, (SELECT count(*) FROM g) AS num_packed, (SELECT sum(len(t)) FROM s)::BIGINT AS total_tokens, (SELECT sum(least(len(t), {ROW})) FROM g) AS u)
SELECT num_sequences, num_packed, total_tokens, round(total_tokens / (num_packed * {ROW}), 6) AS efficiency, round(1 - total_tokens / (num_packed * {ROW}), 6) AS waste, round(u / (num_packed * {ROW}), 6) AS fill FROM k""",
    "q_curriculum_linear": RANKED + f", o AS (SELECT *, least(rank // (n // {STAGES}), {STAGES - 1}) AS own FROM r) SELECT unnest(range(own, {STAGES}))::INTEGER AS stage, rank, doc_id, difficulty FROM o",
    "q_curriculum_step": RANKED + f" SELECT least(rank // (n // {STAGES}), {STAGES - 1})::INTEGER AS stage, rank, doc_id, difficulty FROM r",
    "q_hardest_first": f"WITH {SEQ} SELECT row_number() OVER (ORDER BY len(t) DESC, doc_id) - 1 AS rank, doc_id FROM s",
    "q_stage_for_epoch": f"SELECT event_id, least(floor((event_id % 100) / 100 * {STAGES}), {STAGES - 1})::INTEGER AS stage FROM events",
    "q_token_windows": f"WITH {SEQ}, w AS (SELECT doc_id, t, unnest(range(1, len(t) - 15)) AS i FROM s WHERE len(t) > 16) SELECT doc_id, count(*) AS windows, sum(t[i] * 31 + t[i + 16])::BIGINT AS checksum FROM w GROUP BY doc_id",
    "q_stream_windows": """WITH w AS (SELECT event_id AS idx, list(user_id) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS r FROM events)
SELECT idx, array_to_string(r[1:8], ' ') AS x, array_to_string(r[2:9], ' ') AS y FROM w WHERE len(r) = 9""",
    "q_mixture_schedule": SRC + """, p AS (SELECT ds_idx, size, greatest(1, floor(size * weight / (SELECT sum(weight) FROM z))) AS take FROM z),
q AS (SELECT ds_idx, take, unnest(range(0, size)) AS sample_idx FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY ds_idx ORDER BY md5('42s:' || ds_idx || ':' || sample_idx)) AS r FROM q)
SELECT ds_idx, sample_idx, md5('42o:' || ds_idx || ':' || sample_idx) AS order_key FROM k WHERE r <= take""",
    "q_configured_pipeline": f"""WITH k AS (SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 100 AND 3000 QUALIFY row_number() OVER (PARTITION BY {DIGEST} ORDER BY doc_id) = 1),
r AS (SELECT doc_id, row_number() OVER (ORDER BY len({WORDS}), doc_id) - 1 AS rank, count(*) OVER () AS n FROM k)
SELECT least(rank // (n // 5), 4)::INTEGER AS stage, count(*) AS documents, sum(doc_id)::BIGINT AS checksum FROM r GROUP BY 1""",
    "q_replacement_draws": """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rank FROM events), a AS (SELECT i AS draw, (('0x' || md5('3:' || i)[1:12])::BIGINT % (SELECT count(*) FROM events)) AS rank FROM range(5000) t(i))
SELECT draw, event_id FROM a JOIN e USING (rank)""",
    "q_bpe_pairs": """WITH h AS (SELECT hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), p AS (SELECT unnest(list_transform(range(1, length(h) - 2, 2), lambda i: h[i:i + 3])) AS x FROM h WHERE length(h) >= 4)
SELECT ('0x' || x[1:2])::INTEGER AS "left", ('0x' || x[3:4])::INTEGER AS "right", count(*) AS n FROM p GROUP BY 1, 2""",
}
