"""Queries over preference data, evaluations, runs, configurations, losses, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import losses
from textmill.functions import text as tx
from textmill.operators import configs, evaluation, preference, runs, synthetic
from textmill.plans.curation import S, documents
from textmill.runtime import shared_dir
from textmill.streaming import curation as streams


def _pairs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Each pair once. Only the columns asked for go through the shuffle."""
    return spark.read.parquet(f"{d}/preference_pairs.parquet").select("pair_id", *(cols or ("prompt", "chosen", "rejected"))).distinct()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/eval_items.parquet").distinct()


def q_best_of_n(spark: SparkSession, d: str) -> DataFrame:
    """All answers to a prompt are its samples, rewarded by their words."""
    p = _pairs(spark, d)
    samples = p.select("prompt", (F.col("pair_id") * 2).alias("i"), F.col("chosen").alias("t")).union(p.select("prompt", F.col("pair_id") * 2 + 1, "rejected"))
    return preference.best_of_n(samples, ["prompt"], "i", "t", preference.word_reward(F.col("t")))


def q_pairs_two_models(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "chosen", "rejected", "chosen_score", "rejected_score").where("chosen_score is not null and rejected_score is not null")
    pair = preference.pairs_of_two(F.col("rejected"), F.col("chosen"), F.col("rejected_score"), F.col("chosen_score"))
    return p.select("pair_id", pair.alias("p")).select("pair_id", "p.*")


def q_preference_accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = preference.preference_accuracy(_pairs(spark, d, "chosen_score", "rejected_score", "source").where("chosen_score is not null and rejected_score is not null"), F.col("chosen_score") - F.col("rejected_score"), ["source"])
    return a.select("source", "correct", "total", F.round("accuracy", 6).alias("accuracy"), F.round("mean_score", 6).alias("mean_score"))


def q_validate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return preference.all_valid(_pairs(spark, d))


def q_complete_pairs(spark: SparkSession, d: str) -> DataFrame:
    return preference.complete(_pairs(spark, d)).select("pair_id", preference.format_pair(F.col("prompt"), F.col("chosen"), F.col("rejected")).alias("p")).select("pair_id", "p.*")


def q_preference_texts(spark: SparkSession, d: str) -> DataFrame:
    return preference.complete(_pairs(spark, d)).select("pair_id", F.concat("prompt", "chosen").alias("good"), F.concat("prompt", "rejected").alias("bad"))


def q_critique_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = preference.complete(_pairs(spark, d))
    c = preference.critique_prompt(F.col("rejected"), preference.pick(["be brief", "be kind", "be exact"], F.col("pair_id"), 7))
    return p.select("pair_id", c.alias("critique"), preference.revision_prompt(F.col("rejected"), F.col("chosen")).alias("revision"))


def q_number_extract(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", evaluation.extract_number(F.col("text")).alias("answer"))


def q_choice_extract(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", evaluation.extract_choice(F.col("text")).alias("answer"))


def q_item_prompts(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return _items(spark, d).select("item_id", evaluation.gsm8k_prompt(q).alias("plain"), evaluation.mmlu_prompt(q, F.col("choices")).alias("choice"), evaluation.gsm8k_gold(F.col("answer")).alias("gold"))


def q_eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Answers taken out of the questions themselves, held against the gold."""
    i = _items(spark, d)
    return evaluation.accuracy(i, evaluation.extract_number(F.col("question")), evaluation.gsm8k_gold(F.col("answer")), ["task"]).select("task", "correct", "total", F.round("accuracy", 6).alias("accuracy"))


def q_pass_at_1(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(f"{d}/filter_results.parquet").select("sample_id", "source", "passed").distinct()
    return evaluation.pass_rate(log, F.col("passed"), ["source"]).select("source", "passed", "total", F.round("pass_at_1", 6).alias("pass_at_1"))


def q_helpfulness(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "chosen", "source").groupBy("source").agg(F.count_if(evaluation.is_helpful(F.col("chosen"))).alias("helpful"), F.count(F.lit(1)).alias("total"))


def q_eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/eval_results.parquet").select("run_id", "task", "metric", "value").distinct().where(~F.isnan("value"))
    return evaluation.aggregate_metrics(r, ["run_id"]).select("run_id", F.round("mean_score", 6).alias("mean_score"), "num_tasks")


def q_benchmark_suite(spark: SparkSession, d: str) -> DataFrame:
    """The items' questions as predictions of their answers; two tasks have no such outcome."""
    i = _items(spark, d)
    p = i.select("task", evaluation.extract_number(F.col("question")).alias("prediction"), evaluation.gsm8k_gold(F.col("answer")).alias("gold"), (F.col("item_id") % 2 == 0).alias("passed"), (F.col("item_id") % 3 - 1).alias("score"))
    return evaluation.benchmark_suite(p).select("task", "metric", F.round("value", 6).alias("value"), "error")


def q_self_instruct_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" Instruction: "), F.col("question"), F.lit("\nResponse: "), F.coalesce("answer", F.lit("Response: none ")))
    return _items(spark, d).select("item_id", synthetic.parse_instruction(text).alias("p")).select("item_id", "p.*")


def q_math_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("question"), F.lit(" Solution: add up. Answer: "), F.coalesce("answer", F.lit("")), F.lit(" Solution: again"))
    return _items(spark, d).select("item_id", synthetic.parse_math(text).alias("p")).select("item_id", "p.*")


def q_synthetic_prompts(spark: SparkSession, d: str) -> DataFrame:
    kind = preference.pick(list(synthetic.EVOLUTIONS), F.col("item_id"))
    shown = F.array(F.struct(F.col("question").alias("instruction"), F.coalesce("answer", F.lit("")).alias("response")))
    return _items(spark, d).select("item_id", synthetic.evolution_prompt(F.col("question"), kind).alias("evolve"), synthetic.self_instruct_prompt(shown).alias("instruct"), synthetic.math_prompt(F.lit("hard"), F.col("task")).alias("math"))


def _log(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Each step once, as it arrived last, with the columns asked for."""
    return runs.once(spark.read.parquet(f"{d}/metrics_log.parquet").select("run_id", "iter", *cols, "ingested_at"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/train_runs.parquet").distinct()


def q_metrics_best(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_val_loss(_log(spark, d, "val_loss"), ["run_id"])


def q_metrics_last(spark: SparkSession, d: str) -> DataFrame:
    return runs.last_metrics(_log(spark, d, "train_loss", "lr"), ["run_id"], ["train_loss", "lr"])


def q_sweep_rank(spark: SparkSession, d: str) -> DataFrame:
    best = runs.best_val_loss(_log(spark, d, "val_loss"), ["run_id"]).select("run_id", F.col("best_val_loss").alias("val_loss"))
    joined = _runs(spark, d).join(best, "run_id", "left")
    return runs.sweep_rank(joined, "run_id", by=["mutation_type"]).select("mutation_type", F.col("rank").cast("long").alias("rank"), "run_id", "val_loss")


def q_ab_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each run against its parent."""
    best = runs.best_val_loss(_log(spark, d, "val_loss"), ["run_id"]).select("run_id", F.col("best_val_loss").alias("loss"))
    r = _runs(spark, d).select("run_id", "parent_run_id").join(best, "run_id")
    both = r.join(best.select(F.col("run_id").alias("parent_run_id"), F.col("loss").alias("base")), "parent_run_id").select("run_id", "parent_run_id", runs.compare(F.col("base"), F.col("loss")).alias("c"))
    return both.select("run_id", "parent_run_id", F.round("c.improvement_pct", 4).alias("improvement_pct"), "c.mutation_wins")


def q_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("mutation_type", "generation").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("parent_run_id").alias("parents"))


def q_log_scrape(spark: SparkSession, d: str) -> DataFrame:
    """Losses out of printed log lines."""
    line = F.concat(F.lit("step "), F.col("iter").cast("string"), F.lit(": train loss "), F.format_string("%.5f", F.col("train_loss")), F.lit(", val loss "), F.format_string("%.5f", F.col("val_loss")))
    lines = _log(spark, d, "train_loss", "val_loss").select("run_id", F.col("iter").alias("line_no"), line.alias("value"))
    return runs.scrape_log(lines, by=["run_id"])


def q_lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    it = spark.read.parquet(f"{d}/metrics_log.parquet").select("iter").distinct()
    return it.select("iter", F.round(runs.learning_rate(F.col("iter"), 6e-4, 6e-5, 100, 5000), 12).alias("lr"))


def q_ema_loss(spark: SparkSession, d: str) -> DataFrame:
    ok = _log(spark, d, "train_loss").where("train_loss is not null and not isnan(train_loss)")
    return runs.ema(ok, ["run_id"], "train_loss").select("run_id", "iter", F.round("ema", 5).alias("ema"))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    ok = _log(spark, d, "train_loss").where("train_loss is not null and not isnan(train_loss) and iter is not null")
    return ok.select("run_id", "iter", "train_loss", ((F.col("iter") + 1) * 1e-6).alias("rate"))


def q_lr_finder(spark: SparkSession, d: str) -> DataFrame:
    return runs.lr_finder(_rated(spark, d), ["run_id"], "rate", "train_loss", "iter").select("run_id", "points", *[F.round(c, 10).alias(c) for c in ("suggested_lr", "steepest_lr", "min_loss_lr")])


def q_divergence(spark: SparkSession, d: str) -> DataFrame:
    cut = runs.until_divergence(_rated(spark, d), ["run_id"], "train_loss", "iter", factor=1.5)
    return cut.groupBy("run_id").agg(F.count(F.lit(1)).alias("points"), F.max("iter").alias("last_iter"))


def q_val_points(spark: SparkSession, d: str) -> DataFrame:
    return runs.has_val(_log(spark, d, "val_loss")).groupBy("run_id").agg(F.count(F.lit(1)).alias("points"))


def q_noise_scale(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null")
    return runs.noise_scale(v, ["label"], "embedding").select("label", "n", F.round("noise_scale", 4).alias("noise_scale"))


def q_config_grid(spark: SparkSession, d: str) -> DataFrame:
    """Variants of the runs' layer counts, and their rules."""
    layers = [str(r["n_layer"]) for r in _runs(spark, d).where("n_layer is not null").select("n_layer").distinct().orderBy("n_layer").limit(1001).collect()]
    if len(layers) > 1000:
        raise ValueError("a grid is a short list")
    grid = configs.mutate(configs.baseline(spark), "depth", layers or ["12"])
    return grid.select("name", F.col("model_args.n_layer").alias("n_layer"), F.col("_metadata.generation").alias("generation"), F.size(configs.run_violations()).cast("long").alias("violations"))


def q_config_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = [{"name": str(w), "training": {"seed": 1}, "model_args": {"n_embd": w, "n_head": h, "n_kv_head": k}} for w in (96, 100, 384, 768) for h in (1, 5, 6, 12) for k in (1, 4, 6)]
    return configs.baseline(spark, rows).select("name", "model_args.n_head", "model_args.n_kv_head", F.array_join(configs.violations(), "; ").alias("violations"))


def q_dpo_loss(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "chosen_score", "rejected_score", "source").where("chosen_score is not null and rejected_score is not null")
    loss = losses.dpo_loss(F.col("chosen_score"), F.col("rejected_score"), F.lit(0.1), F.lit(0.05), 0.1, 0.05)
    return p.groupBy("source").agg(F.round(F.avg(loss), 6).alias("loss"), F.count(F.lit(1)).alias("pairs"))


def q_token_losses(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    x, y = F.col("x"), F.col("label")
    return e.select("vec_id", F.round(losses.cross_entropy(x, y), 6).alias("ce"), F.round(losses.focal_loss(x, y), 6).alias("focal"), F.round(losses.smoothed_loss(x, y), 6).alias("smoothed"))


def q_topk_route(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.explode(losses.top_k_route(F.col("embedding").cast("array<double>"), 2)).alias("r"))
    return e.groupBy(F.col("r.expert").alias("expert")).agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("r.weight"), 4).alias("weight"))


def q_top_k_logits(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", losses.top_k_logits(F.col("embedding").cast("array<double>"), 5).alias("x"))
    return e.select("vec_id", F.size(F.filter("x", lambda v: v > float("-inf"))).cast("long").alias("kept"), F.round(F.array_max("x"), 6).alias("top"))


def q_loss_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of runs by status."""
    joined = _log(spark, d, "train_loss").join(_runs(spark, d).select("run_id", "status"), "run_id").where("train_loss is not null and not isnan(train_loss)")
    return runs.mean_by_split(joined, "status", "train_loss").select("status", F.round("loss", 6).alias("loss"), "batches", F.round("perplexity", 4).alias("perplexity"))


def q_parameter_ema(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(runs.parameter_ema(F.col("embedding").cast("array<double>"), 0.99), 6).alias("shadow"))
    return e


def q_sliding_mask(spark: SparkSession, d: str) -> DataFrame:
    return losses.mask(spark, 64, losses.sliding_window(7))


def q_sparse_mask(spark: SparkSession, d: str) -> DataFrame:
    return losses.mask(spark, 64, losses.sparse_window(4, 8))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table's files as a stream, be it one file or a folder of them."""
    path = f"{d}/events.parquet"
    table = spark.read.parquet(path)
    single = any(f.endswith("/events.parquet") for f in table.inputFiles())
    stream = spark.readStream.schema(table.schema)
    return stream.option("pathGlobFilter", "events.parquet").parquet(d) if single else stream.parquet(path)


def _run(spark: SparkSession, df: DataFrame) -> DataFrame:
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return streams.run_to_table(df, f"{work}/out", f"{work}/state")


def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and kind, the first within a horizon longer than the data."""
    s = streams.stream_dedupe(_event_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days")
    return _run(spark, s).select("user_id", "event_type")


def q_stream_stats(spark: SparkSession, d: str) -> DataFrame:
    s = streams.windowed_stats(_event_stream(spark, d), "ts", "value", ["event_type"], "1 day", "0 seconds")
    out = _run(spark, s)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"))


L = """WITH l AS (SELECT * FROM (SELECT run_id, iter, train_loss, val_loss, lr, ingested_at, row_number() OVER (PARTITION BY run_id, iter ORDER BY ingested_at DESC) AS k FROM metrics_log) WHERE k = 1)"""
P = "WITH p AS (SELECT DISTINCT pair_id, prompt, chosen, rejected, chosen_score, rejected_score, source FROM preference_pairs)"
I = "WITH i AS (SELECT DISTINCT * FROM eval_items)"
R = ", r AS (SELECT DISTINCT * FROM train_runs)"
BEST = ", b AS (SELECT run_id, min(val_loss) AS best_val_loss FROM l WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) GROUP BY run_id), m AS (SELECT b.run_id, best_val_loss, min(iter) AS best_iter FROM b JOIN l ON l.run_id = b.run_id AND l.val_loss = best_val_loss GROUP BY ALL)"
_w = lambda c: rf"len(list_filter(regexp_split_to_array({c}, '[{S}]+'), lambda w: w <> ''))"
# non-ASCII letters and digits count as word characters
_ascii = lambda c: rf"regexp_replace({c}, '[^\x00-\x7F]', '', 'g')"
_plain = lambda c: rf"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"
NUM = lambda c: rf"""replace(coalesce(list_last(regexp_extract_all({c}, '####[{S}]*([0-9,\.]+)', 1)), list_last(regexp_extract_all(lower({c}), '(?:answer is|equals?)[{S}]*([0-9,\.]+)', 1)), list_last(regexp_extract_all({_plain(c)}, '\b([0-9,\.]+)\b', 1))), ',', '')"""
PICK = lambda key, n, seed: f"(('0x' || md5('{seed}:' || {key})[1:8])::BIGINT % {n})"
GOLD = rf"replace(regexp_replace(list_last(string_split(answer, '####')), '^[{S}]+|[{S}]+\z', '', 'g'), ',', '')"
LSE = "(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))))"
RATE = L + ", o AS (SELECT run_id, iter, train_loss, (iter + 1) * 1e-6 AS rate FROM l WHERE train_loss IS NOT NULL AND NOT isnan(train_loss) AND iter IS NOT NULL)"
E_CASE = "CASE " + " ".join(f"WHEN k = {n} THEN '{h}' || question || '{t}'".replace("\n", "' || chr(10) || '") for n, (h, t) in enumerate(synthetic.EVOLUTIONS.values())) + " END"
_nl = lambda s: ("'" + s + "'").replace("\n", "' || chr(10) || '")

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_best_of_n": P + f""", s AS (SELECT prompt, pair_id * 2 AS i, chosen AS t FROM p UNION ALL SELECT prompt, pair_id * 2 + 1, rejected FROM p), w AS (SELECT *, {_w('t')}::DOUBLE AS r FROM s WHERE t IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY r DESC, i) AS hi, row_number() OVER (PARTITION BY prompt ORDER BY r, i DESC) AS lo FROM w)
SELECT a.prompt, a.t AS chosen, b.t AS rejected, a.r AS chosen_score, b.r AS rejected_score FROM k a JOIN k b ON a.prompt = b.prompt WHERE a.hi = 1 AND b.lo = 1""",
    "q_pairs_two_models": P + """ SELECT pair_id, CASE WHEN rejected_score >= chosen_score THEN rejected ELSE chosen END AS chosen, CASE WHEN rejected_score >= chosen_score THEN chosen ELSE rejected END AS rejected,
greatest(rejected_score, chosen_score) AS chosen_score, least(rejected_score, chosen_score) AS rejected_score FROM p WHERE chosen_score IS NOT NULL AND rejected_score IS NOT NULL""",
    "q_preference_accuracy": P + """ SELECT source, count(*) FILTER (chosen_score - rejected_score > 0) AS correct, count(*) AS total, round(count(*) FILTER (chosen_score - rejected_score > 0) / count(*), 6) AS accuracy, round(avg(chosen_score - rejected_score), 6) AS mean_score
FROM p WHERE chosen_score IS NOT NULL AND rejected_score IS NOT NULL GROUP BY source""",
    "q_validate_pairs": P + " SELECT bool_and(prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL) AS valid, count(*) AS pairs, count(*) FILTER (prompt IS NULL OR chosen IS NULL OR rejected IS NULL) AS invalid FROM p",
    "q_complete_pairs": P + " SELECT pair_id, prompt, chosen, rejected FROM p WHERE length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0",
    "q_preference_texts": P + " SELECT pair_id, prompt || chosen AS good, prompt || rejected AS bad FROM p WHERE length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0",
    "q_critique_prompts": P + f""" SELECT pair_id, 'Response: ' || rejected || chr(10) || chr(10) || 'Critique this response based on: ' || ['be brief', 'be kind', 'be exact'][{PICK('pair_id', 3, 7)} + 1] || chr(10) || chr(10) || 'Critique:' AS critique,
'Original response: ' || rejected || chr(10) || chr(10) || 'Critique: ' || chosen || chr(10) || chr(10) || 'Revised response following the critique:' AS revision FROM p WHERE length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0""",
    "q_number_extract": f"SELECT doc_id, {NUM('text')} AS answer FROM documents WHERE text IS NOT NULL",
    "q_choice_extract": rf"SELECT doc_id, list_first(regexp_extract_all({_plain('upper(text)')}, '\b([A-D])\b', 1)) AS answer FROM documents WHERE text IS NOT NULL",
    "q_item_prompts": I + f""" SELECT item_id, 'Question: ' || question || chr(10) || 'Answer:' AS plain,
CASE WHEN choices IS NOT NULL THEN 'Question: ' || question || chr(10) || coalesce(array_to_string(list_transform(choices, lambda c, k: chr(64 + k::INTEGER) || '. ' || c || chr(10)), ''), '') || 'Answer:' END AS choice, {GOLD} AS gold FROM i""",
    "q_eval_accuracy": I + f", k AS (SELECT task, {NUM('question')} AS a, {GOLD} AS g FROM i) SELECT task, count(*) FILTER (a = g AND length(a) > 0) AS correct, count(*) AS total, round(count(*) FILTER (a = g AND length(a) > 0) / count(*), 6) AS accuracy FROM k GROUP BY task",
    "q_pass_at_1": "WITH l AS (SELECT DISTINCT sample_id, source, passed FROM filter_results) SELECT source, count(*) FILTER (passed) AS passed, count(*) AS total, round(count(*) FILTER (passed) / count(*), 6) AS pass_at_1 FROM l GROUP BY source",
    "q_helpfulness": P + rf", k AS (SELECT source, regexp_replace(chosen, '^[{S}]+|[{S}]+\z', '', 'g') AS t FROM p) SELECT source, count(*) FILTER (length(t) > 20 AND NOT starts_with(t, 'I cannot')) AS helpful, count(*) AS total FROM k GROUP BY source",
    "q_eval_aggregate": "WITH r AS (SELECT DISTINCT run_id, task, metric, value FROM eval_results WHERE value IS NOT NULL AND NOT isnan(value)) SELECT run_id, round(avg(value), 6) AS mean_score, count(*) AS num_tasks FROM r WHERE (task, metric) IN (('gsm8k', 'accuracy'), ('mmlu', 'accuracy'), ('humaneval', 'pass_at_1'), ('constitution', 'preference_accuracy')) GROUP BY run_id",
    "q_benchmark_suite": I + f""", p AS (SELECT task, coalesce({NUM('question')} = {GOLD} AND length({NUM('question')}) > 0, false) AS r, item_id % 2 = 0 AS ok, item_id % 3 - 1 > 0 AS pos FROM i),
e AS (SELECT task, CASE task WHEN 'humaneval' THEN 'pass_at_1' WHEN 'constitution' THEN 'preference_accuracy' ELSE 'accuracy' END AS metric, avg(CASE task WHEN 'humaneval' THEN ok WHEN 'constitution' THEN pos ELSE r END::INTEGER) AS value FROM p GROUP BY task)
SELECT task, metric, round(value, 6) AS value, NULL::VARCHAR AS error FROM e UNION ALL SELECT 'aggregate', 'mean_score', round(avg(value), 6), NULL FROM e""",
    "q_self_instruct_parse": I + rf" SELECT item_id, regexp_replace(question, '^[{S}]+|[{S}]+\z', '', 'g') AS instruction, regexp_replace(coalesce(answer, 'Response: none '), '^[{S}]+|[{S}]+\z', '', 'g') AS response FROM i",
    "q_math_parse": I + rf" SELECT item_id, regexp_replace(question, '^[{S}]+|[{S}]+\z', '', 'g') AS problem, 'add up.' AS solution, regexp_replace(coalesce(answer, ''), '^[{S}]+|[{S}]+\z', '', 'g') AS answer FROM i",
    "q_synthetic_prompts": I + f", k AS (SELECT *, {PICK('item_id', 4, 0)} AS k FROM i) SELECT item_id, {E_CASE} AS evolve, {_nl(synthetic.SELF_INSTRUCT_HEAD)} || 'Instruction: ' || question || chr(10) || 'Response: ' || coalesce(answer, '') || {_nl(synthetic.SELF_INSTRUCT_TAIL)} AS instruct, 'Generate a complex, requires advanced reasoning ' || task || ' math problem with step-by-step solution.' || chr(10) || chr(10) || 'Problem:' AS math FROM k",
    "q_metrics_best": L + BEST + " SELECT run_id, best_val_loss, best_iter FROM m",
    "q_metrics_last": L + " SELECT run_id, iter, train_loss, lr FROM l QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY iter DESC) = 1",
    "q_sweep_rank": L + R + BEST + " SELECT mutation_type, row_number() OVER (PARTITION BY mutation_type ORDER BY best_val_loss, r.run_id) AS rank, r.run_id, best_val_loss AS val_loss FROM r JOIN m USING (run_id) WHERE status = 'success'",
    "q_ab_compare": L + R + BEST + " SELECT r.run_id, r.parent_run_id, CASE WHEN x.best_val_loss <> 0 AND y.best_val_loss <> 0 THEN round((y.best_val_loss - x.best_val_loss) / y.best_val_loss * 100, 4) END AS improvement_pct, CASE WHEN x.best_val_loss <> 0 AND y.best_val_loss <> 0 THEN x.best_val_loss < y.best_val_loss END AS mutation_wins FROM r JOIN m x ON x.run_id = r.run_id JOIN m y ON y.run_id = r.parent_run_id",
    "q_lineage": "WITH r AS (SELECT DISTINCT * FROM train_runs) SELECT mutation_type, generation, count(*) AS runs, count(DISTINCT parent_run_id) AS parents FROM r GROUP BY ALL",
    "q_log_scrape": L + ", k AS (SELECT run_id, iter AS line_no, printf('%.5f', train_loss) AS a, printf('%.5f', val_loss) AS b FROM l WHERE val_loss IS NOT NULL AND train_loss IS NOT NULL AND NOT isnan(train_loss) AND NOT isnan(val_loss)) SELECT run_id, line_no, a::DOUBLE AS train_loss, b::DOUBLE AS val_loss FROM k QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) = 1",
    "q_lr_schedule": "WITH i AS (SELECT DISTINCT iter FROM metrics_log) SELECT iter, round(CASE WHEN iter < 100 THEN (iter + 1) * 6e-4 / 101 WHEN iter > 5000 THEN 6e-5 ELSE 6e-5 + (cos(pi() * (iter - 100) / 4900) + 1) * 0.5 * (6e-4 - 6e-5) END, 12) AS lr FROM i",
    "q_ema_loss": L + ", o AS (SELECT run_id, iter, train_loss AS v, row_number() OVER (PARTITION BY run_id ORDER BY iter) - 1 AS t FROM l WHERE train_loss IS NOT NULL AND NOT isnan(train_loss)) SELECT run_id, iter, round(sum(v * 0.02 * pow(0.98::DOUBLE, -t)) OVER (PARTITION BY run_id ORDER BY t) * pow(0.98::DOUBLE, t) / (1 - pow(0.98::DOUBLE, t + 1)), 5) AS ema FROM o",
    "q_lr_finder": RATE + """, g AS (SELECT *, log10(rate) AS x, lag(log10(rate)) OVER w AS x0, lead(log10(rate)) OVER w AS x1, lag(train_loss) OVER w AS y0, lead(train_loss) OVER w AS y1 FROM o WINDOW w AS (PARTITION BY run_id ORDER BY iter)),
s AS (SELECT *, CASE WHEN x0 IS NULL THEN (y1 - train_loss) / (x1 - x) WHEN x1 IS NULL THEN (train_loss - y0) / (x - x0) ELSE ((x - x0) * (x - x0) * y1 + ((x1 - x) * (x1 - x) - (x - x0) * (x - x0)) * train_loss - (x1 - x) * (x1 - x) * y0) / ((x - x0) * (x1 - x) * (x1 - x0)) END AS slope FROM g),
k AS (SELECT run_id, count(*) AS points, min(rate) AS low, arg_min(rate, (slope, iter)) AS s, arg_min(rate, (train_loss, iter)) AS m FROM s GROUP BY run_id)
SELECT run_id, points, round(CASE WHEN points < 3 THEN low ELSE s / 10 END, 10) AS suggested_lr, round(CASE WHEN points < 3 THEN low ELSE s END, 10) AS steepest_lr, round(CASE WHEN points < 3 THEN low ELSE m END, 10) AS min_loss_lr FROM k""",
    "q_divergence": RATE + """, g AS (SELECT *, min(train_loss) OVER (PARTITION BY run_id ORDER BY iter) AS best FROM o), e AS (SELECT run_id, min(iter) AS stop FROM g WHERE isinf(train_loss) OR (train_loss > best * 1.5 AND iter > 10) GROUP BY run_id)
SELECT g.run_id, count(*) AS points, max(iter) AS last_iter FROM g LEFT JOIN e USING (run_id) WHERE stop IS NULL OR iter <= stop GROUP BY g.run_id""",
    "q_val_points": L + " SELECT run_id, count(*) AS points FROM l WHERE val_loss IS NOT NULL GROUP BY run_id",
    "q_noise_scale": """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL), a AS (SELECT label, count(*) AS n, sum(list_dot_product(x, x)) AS sq FROM e GROUP BY label),
c AS (SELECT label, k, sum(v) AS s FROM (SELECT label, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM e) GROUP BY label, k), b AS (SELECT label, sum(s * s) AS whole FROM c GROUP BY label)
SELECT label, n, round(n * sq / greatest(whole, 1e-8) - 1, 4) AS noise_scale FROM a JOIN b USING (label)""",
    "q_config_grid": "SELECT DISTINCT 'depth_' || n_layer || 'L' AS name, n_layer::INTEGER AS n_layer, 1 AS generation, 0::BIGINT AS violations FROM train_runs WHERE n_layer IS NOT NULL",
    "q_config_rules": """WITH g AS (SELECT w, h, k FROM (VALUES (96), (100), (384), (768)) a(w), (VALUES (1), (5), (6), (12)) b(h), (VALUES (1), (4), (6)) c(k))
SELECT w::VARCHAR AS name, h AS n_head, k AS n_kv_head, array_to_string(list_filter([CASE WHEN w % h <> 0 THEN printf('n_embd (%d) must be divisible by n_head (%d)', w, h) END, CASE WHEN k > h THEN printf('n_kv_head (%d) cannot exceed n_head (%d)', k, h) END,
CASE WHEN h % k <> 0 THEN printf('n_head (%d) must be divisible by n_kv_head (%d)', h, k) END, CASE WHEN (w // h) % 2 <> 0 THEN printf('RoPE requires even head_dim, got %d', w // h) END], lambda x: x IS NOT NULL), '; ') AS violations FROM g""",
    "q_dpo_loss": P + """, z AS (SELECT source, 0.1 * ((chosen_score - rejected_score) - (0.1 - 0.05)) AS z FROM p WHERE chosen_score IS NOT NULL AND rejected_score IS NOT NULL)
SELECT source, round(avg(ln(1 + exp(-z)) * 0.95 + ln(1 + exp(z)) * 0.05), 6) AS loss, count(*) AS pairs FROM z GROUP BY source""",
    "q_token_losses": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE label IS NOT NULL), l AS (SELECT vec_id, x, label, {LSE} AS z FROM e), c AS (SELECT *, z - x[label + 1] AS ce FROM l)
SELECT vec_id, round(ce, 6) AS ce, round(pow(1 - exp(-ce), 2) * ce, 6) AS focal, round(0.9 * ce + 0.1 * (z - list_avg(x)), 6) AS smoothed FROM c""",
    "q_topk_route": """WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, len(embedding))) AS expert FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, expert) AS r FROM e), t AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS w FROM k WHERE r <= 2)
SELECT expert::INTEGER AS expert, count(*) AS tokens, round(sum(w), 4) AS weight FROM t GROUP BY expert""",
    "q_top_k_logits": "WITH e AS (SELECT vec_id, list_reverse_sort(embedding::DOUBLE[]) AS x FROM embeddings) SELECT vec_id, len(list_filter(x, lambda v: v >= x[5])) AS kept, round(x[1], 6) AS top FROM e",
    "q_loss_by_kind": L + R + " SELECT status, round(avg(train_loss), 6) AS loss, count(*) AS batches, round(exp(avg(train_loss)), 4) AS perplexity FROM l JOIN r USING (run_id) WHERE train_loss IS NOT NULL AND NOT isnan(train_loss) GROUP BY status",
    "q_parameter_ema": "WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, len(embedding))) AS k, len(embedding) AS n FROM embeddings) SELECT vec_id, round(sum(v * (CASE WHEN k = 0 THEN 1.0 ELSE 0.01 END) * pow(0.99::DOUBLE, n - 1 - k)) + any_value(0.0), 6) AS shadow FROM e GROUP BY vec_id",
    "q_sliding_mask": "SELECT i::INTEGER AS i, j::INTEGER AS j FROM range(64) a(i), range(64) b(j) WHERE j <= i AND j > i - 7",
    "q_sparse_mask": "SELECT i::INTEGER AS i, j::INTEGER AS j FROM range(64) a(i), range(64) b(j) WHERE j <= i AND (j > i - 4 OR j % 8 = 0)",
    "q_stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "q_stream_stats": "WITH w AS (SELECT event_type, date_trunc('day', ts) AS w, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, count(*) AS days, sum(n)::BIGINT AS n FROM w WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY event_type",
}
