"""Queries that go through files, generators, mutations, and array expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import losses
from textmill.operators import bpe, configs, curriculum, evaluation, filtering, mixing, preference, runs, synthetic, tokens
from textmill.plans.curation import LENGTH, V, documents
from textmill.runtime import shared_dir
from textmill.sources import jsonl, tokenbin

HEADS, REACH, ALPHABET = 12, 6, 10_000


def _fresh(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/textmill-{tag}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# -- token files -----------------------------------------------------------


def _token_file(spark: SparkSession, d: str) -> str:
    """The texts' lengths as one stream of 16-bit tokens, in order of their ids."""
    tokenbin.register(spark)
    path = _local(_fresh(spark, "tokens"))
    numbered = curriculum.global_rank(documents(spark, d).select("doc_id", (F.coalesce("n_chars", F.lit(0)) % 60_000).alias("token")), [F.asc("doc_id")], "pos")
    numbered.select("pos", "token").repartitionByRange("pos").sortWithinPartitions("pos").write.format("tokenbin").mode("append").option("dtype", "uint16").save(path)
    return path


def q_token_file(spark: SparkSession, d: str) -> DataFrame:
    path = _token_file(spark, d)
    return spark.read.format("tokenbin").option("dtype", "uint16").option("rangeTokens", "500").load(path)


def q_token_file_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows over the token file, as a data set would read it."""
    path = _token_file(spark, d)
    w = tokens.stream_windows(spark.read.format("tokenbin").option("dtype", "uint16").load(path), 8)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("idx", total("x").alias("x"), total("y").alias("y"))


def q_token_file_check(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, counts and problems of the parts of a token file."""
    found = tokens.validate_token_files(spark, _token_file(spark, d))
    return found.agg(F.sum("size_bytes").alias("size_bytes"), F.sum("num_tokens").alias("num_tokens"), F.count("problem").alias("problems"), F.max(F.length("sha256")).alias("digest_length"))


# -- JSON lines ------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/preference_pairs.parquet").select("pair_id", "prompt", "chosen", "rejected", "chosen_score", "rejected_score").distinct()


def q_preference_file(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "preferences")
    jsonl.write(_pairs(spark, d), "preferences", path)
    return jsonl.read(spark, "preferences", path).where("_corrupt_record is null").drop("_corrupt_record")


def q_constitution_file(spark: SparkSession, d: str) -> DataFrame:
    """Complete pairs, written, read and checked."""
    path = _fresh(spark, "constitution")
    jsonl.write(preference.complete(_pairs(spark, d)), "constitution", path)
    return jsonl.read(spark, "constitution", path).select("prompt", "chosen", "rejected")


def q_metrics_file(spark: SparkSession, d: str) -> DataFrame:
    """Metrics appended in two goes and read back."""
    log = runs.once(spark.read.parquet(f"{d}/metrics_log.parquet")).select("iter", "train_loss", "val_loss", "lr", "batch_size", "gns")
    path = _fresh(spark, "metrics")
    runs_of = F.pmod(F.col("iter"), F.lit(2))
    for k in (0, 1):
        jsonl.append_metrics(log.where(runs_of == k), path)
    back = jsonl.read(spark, "metrics", path)
    return back.groupBy("batch_size").agg(F.count(F.lit(1)).alias("rows"), F.count("val_loss").alias("val_points"), F.max("iter").alias("last_iter"), F.min("lr").alias("least_lr"), F.count("gns").alias("gns_points"))


def q_eval_files(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items with and without choices through their own files."""
    items = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "question", "choices", "answer").distinct()
    mmlu, gsm = _fresh(spark, "mmlu"), _fresh(spark, "gsm8k")
    jsonl.write(items.where("choices is not null"), "mmlu", mmlu)
    jsonl.write(items.where("choices is null"), "gsm8k", gsm)
    a = jsonl.read(spark, "mmlu", mmlu).select("question", F.size("choices").cast("long").alias("choices"), "answer")
    return a.union(jsonl.read(spark, "gsm8k", gsm).select("question", F.lit(0).cast("long"), "answer"))


def q_sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """Ranked runs written as a report, replaced once, and read."""
    r = spark.read.parquet(f"{d}/train_runs.parquet").select("run_id", "status", "generation", F.col("n_layer").cast("double").alias("val_loss")).distinct()
    ranked = runs.sweep_rank(r, "run_id", by=["generation"]).select("generation", "rank", "run_id")
    path = _fresh(spark, "report")
    for _ in range(2):
        runs.write_report(ranked, path)
    return spark.read.schema("generation long, rank int, run_id string").json(path)


# -- configurations --------------------------------------------------------

#: A variant of every kind of mutation, and the name it gives.
KINDS = [
    ("attention", "gqa_2kv", "attn_gqa_2kv"), ("attention", "gqa_1kv", "attn_gqa_1kv"), ("attention", "mha", "attn_mha"), ("depth", "8", "depth_8L"), ("width", "512", "width_512d"), ("norm", "rmsnorm", "norm_rmsnorm"), ("activation", "gelu", "act_gelu"),
    ("loss", "focal", "loss_focal"), ("dpo", "0.5,0.1", "dpo_beta0.5_smooth0.1"), ("lr", "3e-4", "lr_3e-04"), ("weight_decay", "1e-2", "wd_1e-02"), ("batch_size", "128", "batch_128"), ("warmup", "500", "warmup_500"), ("grad_clip", "0.5", "gradclip_0.5"),
    ("adam_betas", "0.9,0.999", "adam_b1_0.9_b2_0.999"), ("lora_rank", "16", "lora_r16"), ("lora_alpha", "32", "lora_alpha32"), ("lora_dropout", "0.1", "lora_dropout0.1"), ("curriculum", "length,linear,4", "curriculum_length_linear_4stages"),
    ("constitution", "data/constitutions/helpful.jsonl", "constitution_helpful"), ("sliding_window", "256", "sw256"), ("moe", "8,2", "moe_8e2k"), ("mla", "128", "mla_latent128"), ("sparse_attention", "64,16", "sparse_b64_s16"), ("conversation_format", "chatml", "conv_chatml"),
]


def q_mutation_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of mutation of the baseline, with the fields that it sets."""
    out = None
    base = configs.baseline(spark)
    for kind, variant, _ in KINDS:
        made = configs.mutate(base, kind, [variant]).select(
            F.lit(kind).alias("kind"), F.lit(variant).alias("variant"), "name", F.col("_metadata.mutation_type").alias("recorded"), F.col("model_args.n_layer").alias("n_layer"), F.col("model_args.n_embd").alias("n_embd"),
            F.col("model_args.n_kv_head").alias("n_kv_head"), F.col("training.learning_rate").alias("learning_rate"), F.col("training.batch_size").alias("batch_size"), F.col("training.warmup_iters").alias("warmup_iters"), F.col("lora.r").alias("lora_r"),
        )
        out = made if out is None else out.union(made)
    return out


def q_config_files(spark: SparkSession, d: str) -> DataFrame:
    """A grid written as YAML and read back."""
    sizes = [(r["n_layer"]) for r in spark.read.parquet(f"{d}/train_runs.parquet").where("n_layer is not null").select("n_layer").distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("a grid is a short list")
    grid = configs.mutate(configs.baseline(spark), "depth", [str(n) for n in sizes] or ["12"])
    back = configs.read_yaml(spark, configs.write_yaml(grid, _local(_fresh(spark, "configs"))))
    return back.select("name", F.col("model_args.n_layer").alias("n_layer"), F.col("_metadata.parent_config").alias("parent"))


def q_split_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = ["a/train.bin", "a/val.bin", "b_train.bin", "b_val.bin", "c.bin", "plain"]
    return spark.createDataFrame([(p, tokens.split_path(p, "train"), tokens.split_path(p, "val")) for p in paths], "path string, train string, val string")


# -- generators with a model that is a rule --------------------------------


def _echo(tail: str):
    return lambda: lambda prompts: [p + tail for p in prompts]


def _digest():
    import hashlib

    return lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def q_self_instruct(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([(f"task {k}", f"answer {k}") for k in range(5)], "instruction string, response string")
    return synthetic.self_instruct(seeds, 40, _echo("Count to three.\nResponse: one two three"))


def q_evol_instruct(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds that each evolve all tasks there are."""
    base = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", F.col("question").alias("instruction"), F.col("answer").alias("response")).distinct()
    out = synthetic.evol_instruct(base, "item_id", 2, _echo("  a harder task "), sample=100_000)
    return out.select("item_id", "round", "instruction", "response")


def q_math_problems(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.math_problems(spark, 50, _echo("two and two\nSolution: add them\nAnswer: 4"))


def q_constitution_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The revision depends on the critique, and that on the first answer."""
    items = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "question").distinct()
    made = preference.constitution_pairs(items, "item_id", "question", ["be exact"], _digest)
    return made.select("item_id", "prompt", "rejected", F.length("chosen").alias("chosen_length"), (F.col("chosen") != F.col("rejected")).alias("revised"))


def q_continuations(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).where("chosen is not null")
    return p.select("pair_id", synthetic.continuation(F.concat("prompt", "chosen"), F.col("prompt")).alias("said"))


# -- joins and reports -----------------------------------------------------


def q_decision_log(spark: SparkSession, d: str) -> DataFrame:
    """What the pipeline logs of each decision."""
    done = filtering.evaluate(documents(spark, d))
    log = filtering.results(done, "doc_id", "text", [s.name for s in filtering.default_scores()])
    return log.select("doc_id", "passed", F.size("failed_filters").cast("long").alias("failed"), F.round(F.col("scores")["length"], 6).alias("length_score"))


def q_gathered(spark: SparkSession, d: str) -> DataFrame:
    """Records of a schedule that names some more than once."""
    docs = documents(spark, d).select("doc_id", "n_chars")
    records = docs.select((F.col("doc_id") % 3).alias("ds_idx"), F.floor(F.col("doc_id") / 3).alias("sample_idx"), "n_chars")
    schedule = records.select("ds_idx", "sample_idx").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("ds_idx"))))
    return mixing.gather(schedule, records).groupBy("ds_idx").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


def q_gold_join(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/eval_items.parquet").distinct()
    predicted = items.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("answer")).otherwise("none").alias("prediction"))
    joined = evaluation.gold_join(predicted, items.select("item_id", "task", "answer"), "item_id")
    return joined.groupBy("task").agg(F.count(F.lit(1)).alias("items"), F.sum(F.coalesce((F.col("prediction") == F.col("answer")).cast("int"), F.lit(0))).alias("right"))


def q_first_items(spark: SparkSession, d: str) -> DataFrame:
    """A report over the first fifty items."""
    ranked = curriculum.global_rank(spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "task").distinct(), [F.asc("item_id")], "pos")
    return evaluation.first_items(ranked, "pos", 50).select("item_id", "task")


def q_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss and perplexity over the first hundred batches of all runs."""
    log = runs.once(spark.read.parquet(f"{d}/metrics_log.parquet").where("train_loss is not null and not isnan(train_loss)"))
    one = evaluation.mean_loss(log.withColumn("key", F.struct("run_id", "iter")), "train_loss", "key", 100)
    return one.select(F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


def q_parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a table as tensors, one in three of which is trained."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return runs.parameter_counts(e.select("vec_id", F.size("embedding").alias("size")), "size", F.col("vec_id") % 3 == 0).select("total", "trainable", F.round("percent", 6).alias("percent"))


def q_utilisation(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/train_runs.parquet").where("n_layer is not null").select("run_id", "n_layer").distinct()
    share = runs.utilisation(F.lit(65_536), F.lit(2.0), F.col("n_layer") * 7_000_000, F.col("n_layer"), F.lit(768), F.lit(1024))
    return r.select("run_id", F.round(share, 8).alias("share"))


# -- characters and bytes --------------------------------------------------


def q_char_codec(spark: SparkSession, d: str) -> DataFrame:
    """Texts to ids of their characters and back."""
    docs = documents(spark, d).where("text is not null").select("doc_id", "text")
    vocabulary = tokens.char_vocabulary(docs, "text").limit(ALPHABET + 1).collect()
    if len(vocabulary) > ALPHABET:
        raise ValueError("an alphabet is a short list")
    pairs = spark.createDataFrame([(1, {r["char"]: r["id"] for r in vocabulary}, {r["id"]: r["char"] for r in vocabulary})], "k int, stoi map<string,int>, itos map<int,string>")
    ids = docs.crossJoin(F.broadcast(pairs)).select("doc_id", "text", "itos", tokens.char_encode(F.col("text"), F.col("stoi")).alias("ids"))  # one row
    return ids.select("doc_id", F.size("ids").cast("long").alias("ids"), (tokens.char_decode(F.col("ids"), F.col("itos")) == F.col("text")).alias("same"))


def q_merge_file(spark: SparkSession, d: str) -> DataFrame:
    """A table of merges saved, loaded and used."""
    path = _fresh(spark, "merges")
    made = spark.createDataFrame([(104, 101, 256), (256, 108, 257), (116, 104, 258)], "left int, right int, new_id int")
    bpe.save_merges(made, path)
    loaded = bpe.load_merges(spark, path)
    return bpe.encode(spark.createDataFrame([("hello",), ("the help",), ("x",)], "word string"), "word", loaded).select("word", F.array_join("ids", " ").alias("ids"))


# -- expressions over arrays -----------------------------------------------


def q_alibi(spark: SparkSession, d: str) -> DataFrame:
    slopes = F.array(*[F.lit(s) for s in losses.alibi_slopes(HEADS)])
    grid = spark.range(HEADS).select(F.col("id").cast("int").alias("head")).select("head", F.explode(F.sequence(F.lit(0), F.lit(REACH - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("j"))
    return grid.select("head", "i", "j", F.round(losses.alibi_bias(F.get(slopes, F.col("head")), F.col("i"), F.col("j")), 6).alias("bias"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _flat(df: DataFrame, value: str, places: int) -> DataFrame:
    return df.select("vec_id", F.posexplode(value).alias("k", "v")).select("vec_id", "k", F.round("v", places).alias("value"))


def q_rotary(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_vectors(spark, d).select("vec_id", losses.rotate(F.col("x"), F.col("vec_id") % 64).alias("r")), "r", 5)


def q_rms_norm(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_vectors(spark, d).select("vec_id", losses.rms_norm(F.col("x")).alias("r")), "r", 5)


def q_layer_norm(spark: SparkSession, d: str) -> DataFrame:
    """Of queries and keys alike: each vector is normalised by itself."""
    return _flat(_vectors(spark, d).select("vec_id", losses.layer_norm(F.col("x")).alias("r")), "r", 5)


def q_sequence_log_prob(spark: SparkSession, d: str) -> DataFrame:
    """Two steps of a sequence with the same logits."""
    e = _vectors(spark, d).where("label is not null")
    lp = losses.token_log_prob(F.array("x", "x", "x"), F.array(F.lit(0), F.col("label").cast("int"), F.lit(1)))
    return e.select("vec_id", F.round(lp, 6).alias("log_prob"))


QUERIES = {
    "q_token_file": q_token_file, "q_token_file_windows": q_token_file_windows, "q_token_file_check": q_token_file_check, "q_preference_file": q_preference_file, "q_constitution_file": q_constitution_file, "q_metrics_file": q_metrics_file, "q_eval_files": q_eval_files,
    "q_sweep_report": q_sweep_report, "q_mutation_kinds": q_mutation_kinds, "q_config_files": q_config_files, "q_split_paths": q_split_paths, "q_self_instruct": q_self_instruct, "q_evol_instruct": q_evol_instruct, "q_math_problems": q_math_problems,
    "q_constitution_pairs": q_constitution_pairs, "q_continuations": q_continuations, "q_decision_log": q_decision_log, "q_gathered": q_gathered, "q_gold_join": q_gold_join, "q_first_items": q_first_items, "q_mean_loss": q_mean_loss, "q_parameter_counts": q_parameter_counts,
    "q_utilisation": q_utilisation, "q_char_codec": q_char_codec, "q_merge_file": q_merge_file, "q_alibi": q_alibi, "q_rotary": q_rotary, "q_rms_norm": q_rms_norm, "q_layer_norm": q_layer_norm, "q_sequence_log_prob": q_sequence_log_prob,
}
_T = "t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, (coalesce(n_chars, 0) % 60000)::BIGINT AS token FROM documents)"
_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
_LSE = "(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))))"
_LOG = "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, iter ORDER BY ingested_at DESC) AS k FROM metrics_log) WHERE k = 1)"
_P = "WITH p AS (SELECT DISTINCT pair_id, prompt, chosen, rejected, chosen_score, rejected_score FROM preference_pairs)"


def _kinds_sql() -> str:
    """The fields that a kind sets are written down; the others are the baseline's."""
    base = configs.DEFAULTS
    cells = {"n_layer": base["model_args"].get("n_layer"), "n_embd": base["model_args"].get("n_embd"), "n_kv_head": base["model_args"].get("n_kv_head"), "learning_rate": base["training"].get("learning_rate"), "batch_size": base["training"].get("batch_size"), "warmup_iters": base["training"].get("warmup_iters"), "lora_r": base["lora"].get("r")}
    heads = base["model_args"].get("n_head")
    sets = {
        ("attention", "gqa_2kv"): {"n_kv_head": 2}, ("attention", "gqa_1kv"): {"n_kv_head": 1}, ("attention", "mha"): {"n_kv_head": heads}, ("depth", "8"): {"n_layer": 8}, ("width", "512"): {"n_embd": 512, "n_kv_head": 512 // 64 // 3},
        ("lr", "3e-4"): {"learning_rate": 3e-4}, ("batch_size", "128"): {"batch_size": 128}, ("warmup", "500"): {"warmup_iters": 500}, ("lora_rank", "16"): {"lora_r": 16},
    }
    cast = {"learning_rate": "DOUBLE"}
    rows = []
    for kind, variant, name in KINDS:
        values = {**cells, **sets.get((kind, variant), {})}
        fields = ", ".join(f"{'NULL' if v is None else repr(v)}::{cast.get(c, 'INTEGER')} AS {c}" for c, v in values.items())
        rows.append(f"SELECT '{kind}' AS kind, '{variant}' AS variant, '{name}' AS name, '{kind}' AS recorded, {fields}")
    return " UNION ALL ".join(rows)


ORACLES = {
    "q_token_file": f"WITH {_T} SELECT pos, token FROM t",
    "q_token_file_windows": f"WITH {_T}, w AS (SELECT pos AS idx, sum(token) OVER a AS x, sum(token) OVER b AS y, count(*) OVER b AS n FROM t WINDOW a AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), b AS (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) SELECT idx, x::BIGINT AS x, y::BIGINT AS y FROM w WHERE n = 8",
    "q_token_file_check": "SELECT 2 * count(*) AS size_bytes, count(*) AS num_tokens, 0::BIGINT AS problems, 64 AS digest_length FROM documents",
    "q_preference_file": _P + " SELECT prompt, chosen, rejected, chosen_score, rejected_score FROM p",
    "q_constitution_file": _P + " SELECT prompt, chosen, rejected FROM p WHERE prompt <> '' AND chosen <> '' AND rejected <> ''",
    "q_metrics_file": _LOG + " SELECT batch_size, count(*) AS rows, count(val_loss) AS val_points, max(iter) AS last_iter, min(lr) AS least_lr, count(gns) AS gns_points FROM l GROUP BY batch_size",
    "q_eval_files": "SELECT question, coalesce(len(choices), 0)::BIGINT AS choices, answer FROM (SELECT DISTINCT item_id, question, choices, answer FROM eval_items)",
    "q_sweep_report": "WITH r AS (SELECT DISTINCT run_id, status, generation, n_layer FROM train_runs) SELECT generation, row_number() OVER (PARTITION BY generation ORDER BY n_layer, run_id) AS rank, run_id FROM r WHERE status = 'success' AND n_layer IS NOT NULL",
    "q_mutation_kinds": _kinds_sql(),
    "q_config_files": "SELECT DISTINCT 'depth_' || n_layer || 'L' AS name, n_layer::INTEGER AS n_layer, 'baseline' AS parent FROM train_runs WHERE n_layer IS NOT NULL",
    "q_split_paths": "SELECT * FROM (VALUES ('a/train.bin', 'a/train.bin', 'a/val.bin'), ('a/val.bin', 'a/train.bin', 'a/val.bin'), ('b_train.bin', 'b_train.bin', 'b_val.bin'), ('b_val.bin', 'b_train.bin', 'b_val.bin'), ('c.bin', 'c_train.bin', 'c_val.bin'), ('plain', 'plain_train', 'plain_val')) v(path, train, val)",
    "q_self_instruct": "SELECT range AS id, 'Count to three.' AS instruction, 'one two three' AS response FROM range(40)",
    "q_evol_instruct": """WITH b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, question, answer FROM eval_items)
SELECT item_id, 0 AS round, question AS instruction, answer AS response FROM b UNION ALL SELECT item_id || '/1', 1, 'a harder task', answer FROM b
UNION ALL SELECT item_id || '/2', 2, 'a harder task', answer FROM b UNION ALL SELECT item_id || '/1/2', 2, 'a harder task', answer FROM b""",
    "q_math_problems": "SELECT range AS id, 'two and two' AS problem, 'add them' AS solution, '4' AS answer FROM range(50)",
    "q_constitution_pairs": "SELECT DISTINCT item_id, question AS prompt, md5(question) AS rejected, 32 AS chosen_length, true AS revised FROM eval_items WHERE question IS NOT NULL",
    "q_continuations": _P + " SELECT pair_id, chosen AS said FROM p WHERE chosen IS NOT NULL",
    "q_decision_log": V + f" SELECT doc_id, len(f) = 0 AS passed, len(f) AS failed, CASE WHEN text IS NOT NULL THEN round({LENGTH}, 6) END AS length_score FROM v",
    "q_gathered": "SELECT doc_id % 3 AS ds_idx, count(*) * (doc_id % 3 + 1) AS rows, (sum(n_chars) * (doc_id % 3 + 1))::BIGINT AS chars FROM documents GROUP BY doc_id % 3",
    "q_gold_join": "WITH i AS (SELECT DISTINCT * FROM eval_items) SELECT task, count(*) AS items, count(*) FILTER (CASE WHEN item_id % 2 = 0 THEN answer IS NOT NULL ELSE answer = 'none' END) AS right FROM i GROUP BY task".replace("AS right", 'AS "right"'),
    "q_first_items": "SELECT DISTINCT item_id, task FROM eval_items ORDER BY item_id LIMIT 50",
    "q_mean_loss": _LOG.replace("FROM metrics_log", "FROM metrics_log WHERE train_loss IS NOT NULL AND NOT isnan(train_loss)") + ", h AS (SELECT train_loss FROM l ORDER BY run_id, iter LIMIT 100) SELECT round(avg(train_loss), 6) AS loss, round(exp(avg(train_loss)), 4) AS perplexity FROM h",
    "q_parameter_counts": "SELECT sum(len(embedding))::BIGINT AS total, (sum(len(embedding)) FILTER (vec_id % 3 = 0))::BIGINT AS trainable, round(100.0 * sum(len(embedding)) FILTER (vec_id % 3 = 0) / sum(len(embedding)), 6) AS percent FROM embeddings",
    "q_utilisation": "SELECT DISTINCT run_id, round((n_layer * 7000000 * 6 + n_layer * 768 * 1024 * 12) * 65536 / 2.0::DOUBLE / 312e12, 8) AS share FROM train_runs WHERE n_layer IS NOT NULL",
    "q_char_codec": "SELECT doc_id, length(text) AS ids, true AS same FROM documents WHERE text IS NOT NULL",
    "q_merge_file": "SELECT * FROM (VALUES ('hello', '257 108 111'), ('the help', '258 101 32 257 112'), ('x', '120')) v(word, ids)",
    "q_alibi": f"SELECT h::INTEGER AS head, i::INTEGER AS i, j::INTEGER AS j, round(-(i - j) * CASE WHEN h < 8 THEN pow(2.0, -(h + 1)) ELSE pow(2.0, -(2 * (h - 8) + 1) / 2.0) END, 6) AS bias FROM range({HEADS}) a(h), range({REACH}) b(i), range({REACH}) c(j) WHERE j <= i",
    "q_rotary": _E + """, h AS (SELECT *, len(x) AS n, len(x) // 2 AS m FROM e), k AS (SELECT *, unnest(range(0, n)) AS k FROM h), a AS (SELECT *, (vec_id % 64) * pow(10000.0, -2.0 * (k % m) / n) AS t FROM k)
SELECT vec_id, k::INTEGER AS k, round(CASE WHEN k < m THEN x[k + 1] * cos(t) - x[k + m + 1] * sin(t) ELSE x[k + 1] * cos(t) + x[k - m + 1] * sin(t) END, 5) AS value FROM a""",
    "q_rms_norm": _E + ", s AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-6) AS s FROM e) SELECT vec_id, unnest(range(0, len(x)))::INTEGER AS k, round(unnest(x) / s, 5) AS value FROM s",
    "q_layer_norm": _E + ", m AS (SELECT *, list_avg(x) AS m FROM e), s AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x) + 1e-5) AS s FROM m) SELECT vec_id, unnest(range(0, len(x)))::INTEGER AS k, round((unnest(x) - m) / s, 5) AS value FROM s",
    "q_sequence_log_prob": _E + f" SELECT vec_id, round(x[label::INTEGER + 1] + x[2] - 2 * {_LSE}, 6) AS log_prob FROM e WHERE label IS NOT NULL",
}
