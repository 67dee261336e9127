"""The other operators on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions import losses
from textmill.operators import bpe, chat, configs, curriculum, dedup, evaluation, mixing, packing, preference, runs, synthetic, tokens
from textmill.sources import jsonl, tokenbin


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, None), (6, None)], "pos int, t string").repartition(3)
    assert sorted(r["pos"] for r in dedup.dedupe(df, "t", "pos").collect()) == [0, 1, 3, 5, 6]
    assert sorted(r["pos"] for r in dedup.dedupe(df, "t", "pos", "blake2b").collect()) == [0, 1, 3, 5, 6]
    seen = spark.createDataFrame([("a",)], "t string").select(dedup.digest(F.col("t")).alias("digest"))
    assert sorted(r["pos"] for r in dedup.unseen(df, "t", seen).collect()) == [1, 3, 4, 5, 6]
    assert dedup.dedupe(df.limit(0), "t", "pos").count() == 0


def test_greedy_keep_is_not_components(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6)], "a long, b long")
    got = {r["id"]: r["kept"] for r in dedup.greedy_keep(ids, pairs, "id").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}
    old = dedup.greedy_keep(ids, pairs, "id", seen=spark.createDataFrame([(2,)], "id long"))
    assert {r["id"]: r["kept"] for r in old.collect()}[3] is False


@pytest.mark.parametrize("hash_name", ["xxhash64", "blake2b"])
def test_minhash_pairs_equal_brute_force(spark, hash_name):
    r = np.random.default_rng(5)
    base = [[f"w{r.integers(400)}" for _ in range(60)] for _ in range(12)]
    texts = [(i, " ".join(b)) for i, b in enumerate(base)]
    texts += [(100 + i, " ".join(b[:-1] + ["new"])) for i, b in enumerate(base)] + [(200, texts[0][1]), (201, "two words"), (202, "two words"), (203, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    signed = dedup.minhash(df, "id", "text", hash_name=hash_name)
    sig = {r["id"]: r["signature"] for r in signed.collect()}
    same = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 128
    want = {(a, b) for a in sig for b in sig if a < b and same(a, b) >= 0.8}
    got = {(r["a"], r["b"]) for r in dedup.similar_pairs(signed, "id").collect()}
    # of equal signatures only the first one pairs with others
    assert got <= want and {b for _, b in got} == {b for _, b in want}
    kept = {r["id"] for r in dedup.minhash_dedupe(df, "id", "text", hash_name=hash_name).select("id").collect()}
    seq, out = [], set()
    for i in sorted(sig):
        if all(same(j, i) < 0.8 for j in seq):
            seq.append(i)
            out.add(i)
    assert kept == out


def test_templates(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("system", "s"), ("human", "q"), ("gpt", "a")]), (2, [("user", "x")]), (3, None), (4, [(None, None)])], f"i int, m {m}").withColumn("m", chat.known(F.col("m")))
    r = {x["i"]: x for x in df.select("i", chat.chatml(F.col("m")).alias("c"), chat.llama3(F.col("m")).alias("l"), chat.alpaca(F.col("m")).alias("a")).collect()}
    assert r[1]["c"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>"
    assert r[1]["l"].startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\ns<|eot_id|>")
    assert r[1]["a"].endswith("### Instruction:\ns\n\n### Response:\nq") and r[2]["a"] == "" and r[3]["c"] == ""
    assert r[4]["c"] == "<|im_start|>unknown\n<|im_end|>"


def test_json_layouts(spark):
    df = spark.createDataFrame([('{"conversations":[{"from":"human","value":"hi"},{"value":null}]}',), ("{}",), (None,)], "j string")
    rows = [r["m"] for r in df.select(chat.from_sharegpt(F.col("j")).alias("m")).collect()]
    assert [tuple(m) for m in rows[0]] == [("human", "hi"), ("unknown", "")] and rows[1] == [] and rows[2] == []
    assert [tuple(m) for m in spark.createDataFrame([('{"messages":[{"content":"x"}]}',)], "j string").select(chat.from_openai(F.col("j")).alias("m")).first()["m"]] == [("user", "x")]


def test_pack_sequences(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, [6, 7, 8, 9]), (3, None)], "pos long, tokens array<int>")
    packed = packing.pack_sequences(df, "pos", "tokens", 10, eos=99)
    rows = [r["tokens"] for r in packed.orderBy("bin").collect()]
    assert rows == [[6, 7, 8, 9, 99, 1, 2, 3, 99, 0], [4, 5, 99, 0, 0, 0, 0, 0, 0, 0]]
    e = packing.packing_efficiency(df, "tokens", packed, 10).first()
    assert (e["num_sequences"], e["total_tokens"]) == (3, 9) and e["efficiency"] + e["waste"] == pytest.approx(1)
    long = packing.pack_sequences(spark.createDataFrame([(0, list(range(12)))], "pos long, tokens array<int>"), "pos", "tokens", 10, eos=99).first()
    assert long["tokens"] == list(range(10)) and long["truncated"] == 3
    none = packing.pack_sequences(df.limit(0), "pos", "tokens", 10)
    assert none.count() == 0 and packing.packing_efficiency(df.limit(0), "tokens", none, 10).first()["efficiency"] == 0.0


def test_pack_conversations_counts_gaps(spark):
    df = spark.createDataFrame([(0, "a" * 6), (1, "b" * 2), (2, "c" * 4), (3, "d" * 40), (4, None)], "pos long, t string")
    got = [(r["items"], r["text"][0]) for r in chat.pack_conversations(df, "pos", "t", 12, "--").orderBy("pack").collect()]
    assert got == [(2, "a"), (1, "c"), (1, "d")]
    assert sum(r["items"] for r in chat.pack_conversations(df, "pos", "t", 12, "--", shards=3).collect()) == 4


def test_curriculum(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 2, 8, 2, 1, 9, 3, 4])], "pos long, n int").repartition(3)
    ranked = curriculum.order_by_difficulty(df, F.col("n"), "pos")
    assert [r["pos"] for r in ranked.orderBy("rank").collect()] == [4, 1, 3, 6, 7, 0, 2, 5]
    down = curriculum.order_by_difficulty(df, F.col("n"), "pos", reverse=True)
    assert [r["pos"] for r in down.orderBy("rank").collect()] == [5, 2, 0, 7, 6, 1, 3, 4]
    sizes = lambda kind, k=4: [r["count"] for r in curriculum.schedule(ranked, 8, k, kind).groupBy("stage").count().orderBy("stage").collect()]
    assert sizes("linear") == [2, 4, 6, 8] and sizes("step") == [2, 2, 2, 2] and sizes("step", 9) == [8]
    e = spark.createDataFrame([(x,) for x in (0, 25, 50, 75, 99)], "e int").select(curriculum.stage_for_epoch(F.col("e"), F.lit(100)).alias("s"))
    assert [r["s"] for r in e.collect()] == [0, 1, 2, 3, 3]


def test_windows(spark):
    seq = list(range(11))
    w = spark.createDataFrame([(seq,), ([1],), (None,)], "t array<int>").select(F.explode(tokens.windows(F.col("t"), 10)).alias("w")).collect()
    assert len(w) == 1 and w[0]["w"]["x"] == seq[:10] and w[0]["w"]["y"] == seq[1:]
    df = spark.range(57).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("token")).repartition(5)
    for shard in (7, 20, 1000):
        got = {r["idx"]: (list(r["x"]), list(r["y"])) for r in tokens.stream_windows(df, 5, shard=shard).collect()}
        assert got == {i: ([3 * k for k in range(i, i + 5)], [3 * k for k in range(i + 1, i + 6)]) for i in range(52)}


def test_char_codec(spark):
    df = spark.createDataFrame([("ab",), ("ca",), (None,)], "t string")
    assert [(r["id"], r["char"]) for r in tokens.char_vocabulary(df, "t").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    stoi, itos = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(1)), F.create_map(F.lit(0), F.lit("a"), F.lit(1), F.lit("b"))
    r = df.select(tokens.char_encode(F.col("t"), stoi).alias("i")).select("i", tokens.char_decode(F.col("i"), itos).alias("b")).collect()
    assert [(x["i"], x["b"]) for x in r] == [([0, 1], "ab"), ([0], "a"), (None, None)]
    assert [tokens.split_path(p, w) for p, w in (("d/foo_train.bin", "val"), ("d/foo.bin", "val"), ("d/train.bin", "val"), ("d/foo_val.bin", "train"))] == ["d/foo_val.bin", "d/foo_val.bin", "d/val.bin", "d/foo_train.bin"]


def test_tokenize_corpus(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i long, t string")
    got = {r["i"]: r["tokens"] for r in tokens.tokenize_corpus(df, "i", "t", lambda: lambda t: [ord(c) for c in t], eot=0).collect()}
    assert got == {1: [97, 98, 0], 3: [0]}


def test_tokenbin(spark, tmp_path):
    tokenbin.register(spark)
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 500).alias("token"))
    out = str(tmp_path / "bin")
    df.repartitionByRange(4, "pos").sortWithinPartitions("pos").write.format("tokenbin").mode("append").option("dtype", "uint16").save(out)
    back = spark.read.format("tokenbin").option("dtype", "uint16").option("rangeTokens", "130").load(out)
    assert back.rdd.getNumPartitions() > 4 and [(r["pos"], r["token"]) for r in back.orderBy("pos").collect()] == [(i, i % 500) for i in range(1000)]
    assert tokenbin.merge_parts(out, str(tmp_path / "one.bin")) == 2000
    assert np.fromfile(tmp_path / "one.bin", np.uint16).tolist() == [i % 500 for i in range(1000)]
    assert tokenbin.sniff_type(str(tmp_path / "one.bin")) == "uint32"  # misled, as documented
    (tmp_path / "odd.bin").write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")
    for name in ("odd.bin", "none.bin", "missing.bin"):
        with pytest.raises(Exception):
            spark.read.format("tokenbin").load(str(tmp_path / name)).count()
    checks = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in tokens.validate_token_files(spark, str(tmp_path / "*.bin")).collect()}
    assert checks == {"one.bin": None, "odd.bin": "size is no multiple of 2", "none.bin": "empty"}
    with pytest.raises(Exception):
        spark.createDataFrame([(0, 70_000)], "pos long, token long").write.format("tokenbin").mode("append").option("dtype", "uint16").save(out)


def test_mixture_schedule(spark):
    sizes = spark.createDataFrame([(0, 6, 2.0), (1, 6, 3.0), (2, 0, 1.0)], "ds_idx int, size long, weight double")
    rows = mixing.mixture_schedule(sizes, 42).collect()
    assert {d: sum(r["ds_idx"] == d for r in rows) for d in (0, 1, 2)} == {0: 2, 1: 3, 2: 0}
    again = mixing.mixture_schedule(sizes.repartition(7), 42).collect()
    key = lambda rs: sorted((r["order_key"], r["ds_idx"], r["sample_idx"]) for r in rs)
    assert key(rows) == key(again) != key(mixing.mixture_schedule(sizes, 999).collect())
    assert mixing.normalised([2, 3], 2) == [0.4, 0.6]
    for bad in (([1], 2), ([], 0), ([1, 0], 2)):
        with pytest.raises(ValueError):
            mixing.normalised(*bad)


def test_take_least_equals_sort(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").otherwise("cold").alias("g"), F.md5(F.col("id").cast("string")).alias("key"), F.lit(777).alias("take"))
    got = {(r["g"], r["key"]) for r in mixing.take_least(df, ["g"], "key", "take").collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r["g"], []).append(r["key"])
    assert got == {(g, k) for g, ks in by.items() for k in sorted(ks)[:777]}


def naive_merges(ids, table, newest):
    while True:
        known = [table[p] for p in zip(ids, ids[1:]) if p in table]
        if not known:
            return ids
        new, out, k = (max if newest else min)(known), [], 0
        while k < len(ids):
            if k + 1 < len(ids) and table.get((ids[k], ids[k + 1])) == new:
                out.append(new)
                k += 2
            else:
                out.append(ids[k])
                k += 1
        ids = out


def test_bpe(spark):
    r = np.random.default_rng(3)
    table, tokens_ = {}, list(range(97, 101))
    new = 256
    while new < 300:
        pair = (int(r.choice(tokens_)), int(r.choice(tokens_)))
        if pair not in table:
            table[pair] = new
            tokens_.append(new)
            new += 1
    for _ in range(300):
        ids = r.integers(97, 101, r.integers(0, 60)).tolist()
        for newest in (True, False):
            assert bpe.apply_merges(ids, table, newest) == naive_merges(ids, table, newest)
    merges = spark.createDataFrame([(a, b, n) for (a, b), n in table.items()], "left int, right int, new_id int")
    texts = ["abcdabcdaabb", "héé 漢字", "", None, "a" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = bpe.decode(bpe.encode(df, "t", merges), "ids", merges, "back").orderBy("i").collect()
    assert [x["back"] for x in out] == texts and len(out[4]["ids"]) <= 3000
    odd = bpe.decode(spark.createDataFrame([([104, 99999, 200],)], "ids array<int>"), "ids", merges).first()
    assert odd["text"] == "h�" and odd["unknown_ids"] == 1


def test_best_of_n(spark):
    df = spark.createDataFrame([("p", 0, "a", 1.0), ("p", 1, "b", 3.0), ("p", 2, "c", 3.0), ("p", 3, "d", 1.0), ("q", 0, "z", 0.0), ("r", 0, None, 1.0)], "prompt string, i int, t string, s double")
    got = {r["prompt"]: (r["chosen"], r["rejected"], r["chosen_score"]) for r in preference.best_of_n(df, ["prompt"], "i", "t", F.col("s")).collect()}
    assert got == {"p": ("b", "d", 3.0), "q": ("z", "z", 0.0)}


def test_pairs(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 1.0), ("a", "b", 1.0, 2.0)], "x string, y string, s double, t double")
    got = [r["p"]["chosen"] for r in df.select(preference.pairs_of_two(F.col("x"), F.col("y"), F.col("s"), F.col("t")).alias("p")).collect()]
    assert got == ["a", "b"]
    assert df.select(preference.pairs_of_two(F.col("x"), F.col("y"), prefer="b").alias("p")).first()["p"]["chosen"] == "b"
    bad = spark.createDataFrame([("p", "c", None), ("p", "", "r")], "prompt string, chosen string, rejected string")
    assert preference.all_valid(bad).first()["valid"] is False and preference.all_valid(bad.limit(0)).first()["valid"] is True
    assert preference.complete(bad).count() == 0
    assert preference.preference_accuracy(df, F.col("t") - F.col("s")).first()["accuracy"] == 0.5


def test_generation(spark):
    echo = lambda: lambda prompts: [p + " word Response: done" for p in prompts]
    seeds = spark.createDataFrame([("add", "2"), ("sub", "1")], "instruction string, response string")
    got = synthetic.self_instruct(seeds, 3, echo)
    assert [(r["instruction"], r["response"]) for r in got.orderBy("id").collect()] == [("word", "done")] * 3
    assert synthetic.self_instruct(seeds.limit(0), 1, echo).count() == 0
    base = spark.createDataFrame([(1, "do", "ok")], "id int, instruction string, response string")
    evolved = synthetic.evol_instruct(base, "id", 2, lambda: lambda ps: [p + " more" for p in ps])
    assert evolved.count() == 4 and {r["response"] for r in evolved.collect()} == {"ok"}
    maths = synthetic.math_problems(spark, 2, lambda: lambda ps: [p + " one Solution: two Answer: 3" for p in ps])
    assert [(r["problem"], r["solution"], r["answer"]) for r in maths.collect()] == [("one", "two", "3")] * 2
    cons = preference.constitution_pairs(spark.createDataFrame([(1, "hi")], "id int, p string"), "id", "p", ["be kind"], lambda: lambda ps: [f"<{len(p)}>" for p in ps]).first()
    assert cons["rejected"] == "<2>" and cons["chosen"] != cons["rejected"]


def test_parsing(spark):
    texts = ["Instruction: do it Response: yes Response: no", "nothing", "P Solution: S Answer: A Answer: B", "Answer: x Solution: y", "P Solution: S Answer: A Solution: T"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(synthetic.parse_instruction(F.col("t")).alias("i"), synthetic.parse_math(F.col("t")).alias("m")).collect()
    assert tuple(rows[0]["i"]) == ("do it", "yes Response: no") and rows[1]["i"] is None
    assert tuple(rows[2]["m"]) == ("P", "S", "A") and rows[3]["m"] is None and tuple(rows[4]["m"]) == ("P", "S", "A")


def test_extraction(spark):
    cases = [("The answer is 42", "42", None), ("#### 1,234", "1234", None), ("answer is 42.", "42.", None), ("x 7 y 8", "8", None), ("The answer is B", None, "B"), ("none", None, None), ("", None, None), ("a cat", None, "A"), ("漢5字 6", "6", None), ("Take (C)", None, "C")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", evaluation.extract_number(F.col("t")).alias("n"), evaluation.extract_choice(F.col("t")).alias("c"))
    got = {r["i"]: (r["n"], r["c"]) for r in df.collect()}
    for i, (t, n, c) in enumerate(cases):
        assert got[i][0] == n, t
        assert got[i][1] == c, t


def test_eval_aggregates(spark):
    res = spark.createDataFrame([("gsm8k", "accuracy", 0.5), ("mmlu", "accuracy", 0.6), ("humaneval", "pass_at_1", 0.4), ("mmlu", "other", 9.0), ("gsm8k", "accuracy", None)], "task string, metric string, value double")
    r = evaluation.aggregate_metrics(res).first()
    assert r["num_tasks"] == 3 and r["mean_score"] == pytest.approx(0.5)
    none = spark.createDataFrame([], "p string, g string")
    assert evaluation.accuracy(none, F.col("p"), F.col("g")).first()["accuracy"] == 0.0
    loss = evaluation.mean_loss(spark.createDataFrame([(i, 2.5) for i in range(5)], "i int, l double"), "l", "i", 3).first()
    assert loss["perplexity"] == pytest.approx(math.exp(2.5))
    assert evaluation.mean_loss(spark.createDataFrame([], "i int, l double"), "l", "i").first()["loss"] == float("inf")
    helpful = spark.createDataFrame([("I cannot do that, so sorry about it",), ("A long enough helpful answer",), ("short",), (None,)], "t string").select(evaluation.is_helpful(F.col("t")).alias("h"))
    assert [r["h"] for r in helpful.collect()] == [False, True, False, False]


def test_runs(spark):
    log = spark.createDataFrame([("r", 0, 3.0, None), ("r", 1, 2.0, 1.0), ("r", 2, 1.0, 1.0), ("s", 0, float("nan"), float("nan"))], "run_id string, iter long, train_loss double, val_loss double")
    assert [tuple(r) for r in runs.best_val_loss(log, ["run_id"]).collect()] == [("r", 1.0, 1)]
    assert {r["run_id"]: r["iter"] for r in runs.last_metrics(log, ["run_id"], ["train_loss"]).collect()} == {"r": 2, "s": 0}
    table = spark.createDataFrame([("a", "success", 2.0, 0.1), ("b", "success", 1.0, None), ("c", "failed", 0.1, 0.9), ("d", "success", None, 0.5)], "n string, status string, val_loss double, score double")
    assert [r["n"] for r in runs.sweep_rank(table, "n").orderBy("rank").collect()] == ["b", "a"]
    assert [r["n"] for r in runs.sweep_rank(table, "n", "score").orderBy("rank").collect()] == ["a", "b"]
    lines = spark.createDataFrame([(1, "step 1: train loss 2.5, val loss 2.6"), (2, "noise"), (3, "step 9: train loss 1.5, val loss 1.6")], "line_no int, value string")
    assert tuple(runs.scrape_log(lines).first())[1:] == (1.5, 1.6)
    lr = [r["x"] for r in spark.createDataFrame([(i,) for i in (0, 100, 550, 2000)], "i int").select(runs.learning_rate(F.col("i"), 1e-3, 1e-5, 100, 1000).alias("x")).collect()]
    assert lr[0] == pytest.approx(1e-3 / 101) and lr[2] == pytest.approx((1e-3 + 1e-5) / 2) and lr[3] == 1e-5


def test_ema_gradient_divergence(spark):
    r = np.random.default_rng(1)
    xs = r.normal(2, 1, 700).tolist()
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [("b", 5, 1.0), ("b", 6, None)], "run_id string, iter long, v double")
    got = {(x["run_id"], x["iter"]): x["ema"] for x in runs.ema(df, ["run_id"], "v", beta=0.9, chunk=64).collect()}
    a = 0.0
    for t, x in enumerate(xs):
        a = 0.9 * a + 0.1 * x
        assert got[("a", t)] == pytest.approx(a / (1 - 0.9 ** (t + 1)), abs=1e-9)
    assert got[("b", 5)] == pytest.approx(1.0) and len(got) == 701
    x = np.cumsum(r.uniform(0.1, 1, 30))
    y = np.sin(x)
    g = runs.gradient(spark.createDataFrame([("k", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "k string, i int, x double, y double"), ["k"], "x", "y", "i").orderBy("i").collect()
    assert np.allclose([q["slope"] for q in g], np.gradient(y, x))
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0] * 12 + [9.0, 1.0])], "k string, i int, v double")
    assert runs.until_divergence(d, ["k"], "v", "i").count() == 13
    few = runs.lr_finder(spark.createDataFrame([("k", 0, 1e-6, 3.0), ("k", 1, 1e-5, 2.0)], "k string, i int, lr double, v double"), ["k"], "lr", "v", "i").first()
    assert few["suggested_lr"] == 1e-6


def test_noise_scale(spark):
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 3 + [("b", [1.0, 0.0]), ("b", [0.0, 1.0])], "k string, v array<double>")
    got = {r["k"]: r["noise_scale"] for r in runs.noise_scale(same, ["k"], "v").collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(1)


MUTANTS = [
    ("attention", "gqa_1kv", "attn_gqa_1kv", {"model_args.n_kv_head": 1}), ("attention", "mha", "attn_mha", {"model_args.n_kv_head": 12}), ("depth", "8", "depth_8L", {"model_args.n_layer": 8}), ("width", "512", "width_512d", {"model_args.n_embd": 512, "model_args.n_head": 8, "model_args.n_kv_head": 2}),
    ("norm", "layernorm", "norm_layernorm", {"model_args.norm_type": "layernorm"}), ("activation", "gelu", "act_gelu", {"model_args.activation": "gelu"}), ("position", "alibi", "pos_alibi", {"model_args.position_encoding": "alibi"}), ("loss", "focal", "loss_focal", {"model_args.loss_type": "focal"}),
    ("dpo", "0.1,0.05", "dpo_beta0.1_smooth0.05", {"model_args.dpo_beta": 0.1, "model_args.loss_type": "dpo"}), ("mla", "64", "mla_latent64", {"model_args.mla_latent_dim": 64}), ("moe", "8,2", "moe_8e2k", {"model_args.moe_n_experts": 8, "model_args.moe_top_k": 2}), ("sliding_window", "256", "sw256", {"model_args.sliding_window_size": 256}),
    ("sparse_attention", "64", "sparse_b64_s64", {"model_args.sparse_stride": 64}), ("lr", "0.001", "lr_1e-03", {"training.learning_rate": 0.001}), ("batch_size", "32", "batch_32", {"training.batch_size": 32}), ("warmup", "200", "warmup_200", {"training.warmup_iters": 200}), ("grad_clip", "0.5", "gradclip_0.5", {"training.grad_clip": 0.5}),
    ("weight_decay", "0.01", "wd_1e-02", {"training.weight_decay": 0.01}), ("adam_betas", "0.9,0.99", "adam_b1_0.9_b2_0.99", {"training.beta1": 0.9, "training.beta2": 0.99}), ("lora_rank", "16", "lora_r16", {"lora.r": 16, "lora.enabled": True}), ("lora_alpha", "32", "lora_alpha32", {"lora.lora_alpha": 32}), ("lora_dropout", "0.1", "lora_dropout0.1", {"lora.lora_dropout": 0.1}),
    ("data_filter", "10,100", "filter_min10_max100_dedupe", {"data.min_len": 10, "data.max_len": 100, "data.dedupe": True}), ("conversation_format", "llama3", "conv_llama3", {"data.conversation_format": "llama3"}), ("curriculum", "length,linear,4", "curriculum_length_linear_4stages", {"data.curriculum.num_stages": 4}), ("constitution", "data/rules.jsonl", "constitution_rules", {"data.constitution.path": "data/rules.jsonl"}),
]


def test_mutations(spark):
    base = configs.baseline(spark)
    for kind, variant, name, fields in MUTANTS:
        r = configs.mutate(base, kind, [variant]).first()
        assert r["name"] == name, kind
        assert r["_metadata"]["generation"] == 1 and r["_metadata"]["mutation_type"] == kind
        for path, value in fields.items():
            x = r
            for part in path.split("."):
                x = x[part]
            assert x == value, (kind, path)
    with pytest.raises(ValueError):
        configs.mutate(base, "nope", ["1"])
    with pytest.raises(Exception):
        configs.mutate(base, "norm", ["nope"]).collect()


def test_config_rules_and_yaml(spark, tmp_path):
    bad = configs.baseline(spark, [{"name": "x", "model_args": {"n_embd": 100, "norm_type": "odd", "attention_type": "mla", "mlp_type": "moe", "moe_top_k": 9}}])
    got = bad.select(configs.run_violations().alias("v")).first()["v"]
    assert got[0] == "seed is required" and len(got) == 5
    paths = configs.write_yaml(configs.mutate(configs.baseline(spark), "lr", ["0.001"]), str(tmp_path))
    back = configs.read_yaml(spark, paths).first()
    assert back["name"] == "lr_1e-03" and back["training"]["learning_rate"] == 0.001
    (tmp_path / "text.yaml").write_text("training:\n  seed: 1\n  learning_rate: 6e-4\n")
    assert configs.read_yaml(spark, [str(tmp_path / "text.yaml")]).first()["training"]["learning_rate"] == 6e-4
    assert configs.zoo(spark).count() == 4


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([0.0, 0.0, 0.0], 0), ([1000.0, 0.0, 0.0], 1)], "x array<double>, y int")
    rows = df.select("x", "y", losses.cross_entropy(F.col("x"), F.col("y")).alias("ce"), losses.focal_loss(F.col("x"), F.col("y")).alias("f"), losses.smoothed_loss(F.col("x"), F.col("y")).alias("s")).collect()
    for r in rows:
        x = np.array(r["x"])
        lp = x - x.max() - np.log(np.exp(x - x.max()).sum())
        assert r["ce"] == pytest.approx(-lp[r["y"]]) and r["f"] == pytest.approx((1 - np.exp(lp[r["y"]])) ** 2 * -lp[r["y"]]) and r["s"] == pytest.approx(0.9 * -lp[r["y"]] - 0.1 * lp.mean())
    skip = spark.createDataFrame([([1.0, 2.0], -1)], "x array<double>, y int").select(losses.focal_loss(F.col("x"), F.col("y")).alias("f"), losses.smoothed_loss(F.col("x"), F.col("y")).alias("s")).first()
    assert skip["f"] == 0.0 and skip["s"] is None
    d = spark.createDataFrame([(0.0, 0.0), (50.0, -50.0)], "a double, b double").select(losses.dpo_loss(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0)).alias("l")).collect()
    assert d[0]["l"] == pytest.approx(math.log(2)) and 0 <= d[1]["l"] < d[0]["l"]
    route = df.select(losses.top_k_route(F.col("x"), 2).alias("r")).first()["r"]
    assert [e["expert"] for e in route] == [2, 1] and sum(e["weight"] for e in route) == pytest.approx(1)
    seq = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.0], [0.0, 5.0]], [0, 1, 0])], "x array<array<double>>, y array<int>")
    assert seq.select(losses.token_log_prob(F.col("x"), F.col("y")).alias("p")).first()["p"] == pytest.approx(math.log(0.5) + 1 - math.log(math.e + 1))


def test_masks_and_positions(spark):
    m = {(r["i"], r["j"]) for r in losses.mask(spark, 5, losses.sliding_window(3)).collect()}
    assert m == {(i, j) for i in range(5) for j in range(5) if max(0, i - 2) <= j <= i}
    s = {(r["i"], r["j"]) for r in losses.mask(spark, 8, losses.sparse_window(2, 4)).collect()}
    assert {(7, 7), (7, 6), (7, 4), (7, 0)} <= s and (7, 5) not in s
    assert losses.alibi_slopes(8) == [2.0 ** -(k + 1) for k in range(8)] and len(losses.alibi_slopes(12)) == 12
    v = spark.createDataFrame([([3.0, 4.0], 0), ([3.0, 4.0], 5)], "v array<double>, p int").select(losses.rotate(F.col("v"), F.col("p")).alias("r"), losses.rms_norm(F.col("v")).alias("n"), losses.layer_norm(F.col("v")).alias("l")).collect()
    assert v[0]["r"] == [3.0, 4.0] and math.hypot(*v[1]["r"]) == pytest.approx(5)
    assert v[0]["n"][0] == pytest.approx(3 / math.sqrt(12.5), abs=1e-5) and sum(v[0]["l"]) == pytest.approx(0)


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("p", "c", "r", 1.0, None)], "prompt string, chosen string, rejected string, chosen_score double, rejected_score double")
    jsonl.write(df, "preferences", str(tmp_path / "p"))
    assert [r.asDict() for r in jsonl.read(spark, "preferences", str(tmp_path / "p")).drop("_corrupt_record").collect()] == [{"prompt": "p", "chosen": "c", "rejected": "r", "chosen_score": 1.0, "rejected_score": None}]
    (tmp_path / "bad.jsonl").write_text('{"prompt": "a", "chosen": "b", "rejected": "c"}\n\nnot json\n')
    rows = jsonl.read(spark, "constitution", str(tmp_path / "bad.jsonl")).cache().collect()
    assert len(rows) == 2 and rows[1]["_corrupt_record"] == "not json"
    with pytest.raises(Exception):
        jsonl.read(spark, "metrics", str(tmp_path / "missing")).collect()
    m = spark.createDataFrame([(1, 2.0)], "iter long, train_loss double")
    jsonl.append_metrics(m, str(tmp_path / "m"))
    jsonl.append_metrics(m, str(tmp_path / "m"))
    assert jsonl.read(spark, "metrics", str(tmp_path / "m")).count() == 2


def test_small_parts(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "v array<double>").select(runs.parameter_ema(F.col("v"), 0.5).alias("s"), runs.parameter_ema(F.col("v"), 0.5, F.lit(0.0)).alias("z")).collect()
    assert v[0]["s"] == pytest.approx(2.25) and v[0]["z"] == pytest.approx(2.125) and v[1]["z"] == 0.0
    p = spark.createDataFrame([(10, True), (30, False)], "n long, t boolean")
    assert tuple(runs.parameter_counts(p, "n", F.col("t")).first()) == (40, 10, 25.0) and tuple(runs.parameter_counts(p.limit(0), "n", F.col("t")).first()) == (0, 0, 0.0)
    k = spark.createDataFrame([([1.0, 5.0, 5.0, 7.0],)], "x array<double>").select(losses.top_k_logits(F.col("x"), 2).alias("k")).first()["k"]
    assert k == [float("-inf"), 5.0, 5.0, 7.0]
    res = {r["task"]: (r["value"], r["error"]) for r in evaluation.benchmark_suite(spark.createDataFrame([("gsm8k", "1", "1", None, None), ("gsm8k", "", "", None, None), ("nope", "1", "1", None, None)], "task string, prediction string, gold string, passed boolean, score double")).collect()}
    assert res["gsm8k"] == (0.5, None) and res["nope"] == (None, "Unknown task: nope") and res["aggregate"][0] == 0.5
    u = spark.createDataFrame([(100.0, 2.0)], "t double, s double").select(runs.utilisation(F.col("t"), F.col("s"), F.lit(1e9), F.lit(2), F.lit(8), F.lit(16)).alias("u")).first()["u"]
    assert u == pytest.approx((6e9 + 12 * 2 * 8 * 16) * 100 / 2 / 312e12)
    one = configs.from_public(spark.createDataFrame([(64, 2, 1, 100)], "hidden_size int, num_attention_heads int, num_hidden_layers int, vocab_size int")).first()
    assert (one["block_size"], one["n_kv_head"]) == (2048, 2)


def test_draws(spark):
    df = spark.range(10).select(F.col("id").alias("rank"), (F.col("id") * 7).alias("x"))
    rows = mixing.with_replacement(df, "rank", 10, 200, 1).collect()
    assert len(rows) == 200 and {r["x"] for r in rows} == {7 * k for k in range(10)}
    assert mixing.with_replacement(df.limit(0), "rank", 0, 5).count() == 0
    order = [r["rank"] for r in mixing.shuffled(df, "rank", 4).collect()]
    assert sorted(order) == list(range(10)) != order == [r["rank"] for r in mixing.shuffled(df.repartition(3), "rank", 4).collect()]
    plan = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "ds_idx int, sample_idx long")
    assert mixing.gather(plan, spark.createDataFrame([(0, 1, "a"), (1, 0, "b"), (1, 1, "c")], "ds_idx int, sample_idx long, t string")).count() == 3


def test_configured_pipeline(spark, tmp_path):
    from textmill.plans import pipeline

    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, "aa bb", [("user", "x"), ("gpt", "y")]), (2, "aa bb", None), (3, "a", None), (4, "a b c d", None), (5, None, None)], f"id long, text string, messages {m}")
    assert sorted(r["id"] for r in pipeline.curate(df, {"min_len": 2, "dedupe": True}, "id").collect()) == [1, 4]
    staged = pipeline.curate(df, {"min_len": 1, "curriculum": {"enabled": True, "num_stages": 2, "schedule": "step"}}, "id")
    assert {r["id"]: r["stage"] for r in staged.collect()} == {3: 0, 1: 0, 2: 1, 4: 1}
    assert pipeline.curate(df, {"conversation_format": "alpaca"}, "id").where("id = 1").first()["text"].endswith("Response:\ny")
    with pytest.raises(ValueError):
        pipeline.curate(df, {"min_length": 2}, "id")
    (tmp_path / "c.jsonl").write_text('{"prompt": "p", "chosen": "c", "rejected": "r"}\n')
    assert pipeline.preference_source(spark, {"constitution": {"enabled": True, "path": str(tmp_path / "c.jsonl")}}).count() == 1
    assert pipeline.preference_source(spark, {}) is None


def test_hot_keys_are_split(spark):
    from textmill.operators.selfjoin import pairs_by_key

    rows = spark.range(90).select(F.coalesce("id", F.lit(0)).alias("uid"), F.when(F.col("id") < 60, "hot").when(F.col("id") < 80, "warm").alias("k"))
    got = {tuple(r) for r in pairs_by_key(rows, "k", lambda l, r: (F.col(f"{l}.uid") + F.col(f"{r}.uid")) % 2 == 0, bucket=25).collect()}
    assert got == {(a, b) for a in range(80) for b in range(a + 1, 80) if (a < 60) == (b < 60) and (a + b) % 2 == 0}
