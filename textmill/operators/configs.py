"""Grids of run configurations: mutations with provenance, checks, files.

A configuration is a row of nested structs; a mutation is an expression on it,
so a grid is a projection over (configuration, variant) rows. YAML is read and
written on the driver, one small file a run.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields and their defaults.
MODEL = "block_size int, vocab_size int, n_layer int, n_head int, n_kv_head int, n_embd int, dropout double, bias boolean, norm_type string, activation string, position_encoding string, loss_type string, attention_type string, mla_latent_dim int, mlp_type string, moe_n_experts int, moe_top_k int, sliding_window_size int, sparse_block_size int, sparse_stride int, dpo_beta double, dpo_label_smoothing double"
TRAINING = "out_dir string, seed int, learning_rate double, min_lr double, max_iters int, batch_size int, warmup_iters int, lr_decay_iters int, weight_decay double, beta1 double, beta2 double, grad_clip double, ema_decay double"
DATA = "dataset string, batch_size int, block_size int, min_len int, max_len int, dedupe boolean, conversation_format string, curriculum struct<enabled:boolean,strategy:string,schedule:string,num_stages:int>, constitution struct<enabled:boolean,path:string>"
LORA = "enabled boolean, r int, lora_alpha int, lora_dropout double"
META = "parent_config string, mutation_type string, variant string, timestamp string, generation int"
_nested = lambda fields: "struct<" + ",".join(":".join(f.split(" ", 1)) for f in fields.split(", ")) + ">"
SCHEMA = f"name string, run_id string, model_args {_nested(MODEL)}, training {_nested(TRAINING)}, data {_nested(DATA)}, lora {_nested(LORA)}, _metadata {_nested(META)}"
DEFAULTS = {
    "model_args": dict(block_size=1024, vocab_size=50304, n_layer=12, n_head=12, n_kv_head=4, n_embd=768, dropout=0.0, bias=False, norm_type="rmsnorm", activation="swiglu", position_encoding="rope", loss_type="cross_entropy", attention_type="gqa", mlp_type="standard", moe_n_experts=8, moe_top_k=2),
    "training": dict(out_dir="out", learning_rate=6e-4, min_lr=6e-5, max_iters=5000, warmup_iters=100, lr_decay_iters=5000, weight_decay=0.1, beta1=0.9, beta2=0.95, grad_clip=1.0, ema_decay=0.9999),
    "data": dict(dataset="openwebtext", batch_size=64, block_size=256),
    "lora": dict(enabled=False, r=8, lora_alpha=16, lora_dropout=0.0),
}
CHOICES = {
    "norm_type": ["rmsnorm", "layernorm"], "position_encoding": ["rope", "alibi"], "activation": ["swiglu", "gelu", "glu"], "loss_type": ["cross_entropy", "focal", "label_smoothing", "dpo"],
    "attention_type": ["gqa", "mla"], "mlp_type": ["standard", "moe"],
}
FORMATS, STRATEGIES, SCHEDULES = ["chatml", "llama3", "alpaca"], ["length", "perplexity"], ["linear", "step"]
HEAD_DIM = 64


def violations(model: Column | None = None) -> Column:
    """Messages of the rules that a model configuration breaks, in order."""
    model = F.col("model_args") if model is None else model
    m = lambda n: model[n]
    rules = [
        (m("n_embd") % m("n_head") != 0, F.format_string("n_embd (%d) must be divisible by n_head (%d)", m("n_embd"), m("n_head"))),
        (m("n_kv_head") > m("n_head"), F.format_string("n_kv_head (%d) cannot exceed n_head (%d)", m("n_kv_head"), m("n_head"))),
        (m("n_head") % m("n_kv_head") != 0, F.format_string("n_head (%d) must be divisible by n_kv_head (%d)", m("n_head"), m("n_kv_head"))),
        ((m("position_encoding") == "rope") & (F.floor(m("n_embd") / m("n_head")) % 2 != 0), F.format_string("RoPE requires even head_dim, got %d", F.floor(m("n_embd") / m("n_head")))),
        ((m("attention_type") == "mla") & m("mla_latent_dim").isNull(), F.lit("mla_latent_dim required when attention_type='mla'")),
        ((m("mlp_type") == "moe") & (m("moe_top_k") > m("moe_n_experts")), F.format_string("moe_top_k (%d) cannot exceed moe_n_experts (%d)", m("moe_top_k"), m("moe_n_experts"))),
        *[(~m(k).isin(v), F.concat(F.lit(f"Unknown {k}: "), m(k))) for k, v in CHOICES.items()],
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in rules]))


def run_violations() -> Column:
    """Model rules, and that a seed is set."""
    return F.concat(F.array_compact(F.array(F.when(F.col("training.seed").isNull(), F.lit("seed is required")))), violations())


def _choice(kind: str, options: list[str]) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isin(options), v).otherwise(F.raise_error(F.concat(F.lit(f"Unknown {kind}: "), v)).cast("string"))


def _exp(v: Column) -> Column:
    """One digit and a two-digit exponent, as in 1e-03."""
    return F.regexp_replace(F.format_string("%.0e", v.cast("double")), r"\.", "")


def _number(v: Column) -> Column:
    return v.cast("string")


def _set(section: str, **fields):
    return {f"{section}.{k}": v for k, v in fields.items()}


_lit = lambda x: lambda v: F.lit(x)
_int, _dbl = (lambda v: v.cast("int")), (lambda v: v.cast("double"))
_part = lambda i, kind: lambda v: F.get(F.split(v, ","), F.lit(i)).cast(kind)


def _prefix(text: str, shown: Callable[[Column], Column] = _number, tail: str = "") -> Callable[[Column], Column]:
    return lambda v: F.concat(F.lit(text), shown(v), F.lit(tail))


MUTATIONS: dict[str, tuple[Callable[[Column], Column], dict[str, Callable[[Column], Column]]]] = {
    "attention": (_prefix("attn_"), _set("model_args", n_kv_head=lambda v: F.when(v == "mha", F.col("model_args.n_head")).when(v == "gqa_2kv", 2).when(v == "gqa_1kv", 1).otherwise(F.raise_error(F.concat(F.lit("Unknown attention variant: "), v)).cast("int")))),
    "depth": (_prefix("depth_", tail="L"), _set("model_args", n_layer=_int)),
    "width": (_prefix("width_", tail="d"), _set("model_args", n_embd=_int, n_head=lambda v: F.greatest(F.lit(1), F.floor(v.cast("int") / HEAD_DIM)).cast("int"), n_kv_head=lambda v: F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.floor(v.cast("int") / HEAD_DIM)) / 3)).cast("int"))),
    "norm": (_prefix("norm_"), _set("model_args", norm_type=_choice("norm type", CHOICES["norm_type"]))),
    "activation": (_prefix("act_"), _set("model_args", activation=_choice("activation", CHOICES["activation"]))),
    "position": (_prefix("pos_"), _set("model_args", position_encoding=_choice("position encoding", CHOICES["position_encoding"]))),
    "loss": (_prefix("loss_"), _set("model_args", loss_type=_choice("loss type", CHOICES["loss_type"]))),
    "dpo": (lambda v: F.concat(F.lit("dpo_beta"), _part(0, "string")(v), F.when(_part(1, "double")(v) > 0, F.concat(F.lit("_smooth"), _part(1, "string")(v))).otherwise("")), _set("model_args", loss_type=_lit("dpo"), dpo_beta=_part(0, "double"), dpo_label_smoothing=lambda v: F.coalesce(_part(1, "double")(v), F.lit(0.0)))),
    "mla": (lambda v: F.concat(F.lit("mla_latent"), F.coalesce(v.cast("int"), F.floor(F.col("model_args.n_embd") / 2).cast("int")).cast("string")), _set("model_args", attention_type=_lit("mla"), mla_latent_dim=lambda v: F.coalesce(v.cast("int"), F.floor(F.col("model_args.n_embd") / 2).cast("int")))),
    "moe": (lambda v: F.concat(F.lit("moe_"), _part(0, "string")(v), F.lit("e"), F.coalesce(_part(1, "string")(v), F.lit("2")), F.lit("k")), _set("model_args", mlp_type=_lit("moe"), moe_n_experts=_part(0, "int"), moe_top_k=lambda v: F.coalesce(_part(1, "int")(v), F.lit(2)))),
    "sliding_window": (_prefix("sw"), _set("model_args", sliding_window_size=_int)),
    "sparse_attention": (lambda v: F.concat(F.lit("sparse_b"), _part(0, "string")(v), F.lit("_s"), F.coalesce(_part(1, "string")(v), _part(0, "string")(v))), _set("model_args", sparse_block_size=_part(0, "int"), sparse_stride=lambda v: F.coalesce(_part(1, "int")(v), _part(0, "int")(v)))),
    "lr": (_prefix("lr_", _exp), _set("training", learning_rate=_dbl)),
    "batch_size": (_prefix("batch_"), _set("training", batch_size=_int)),
    "warmup": (_prefix("warmup_"), _set("training", warmup_iters=_int)),
    "grad_clip": (_prefix("gradclip_"), _set("training", grad_clip=_dbl)),
    "weight_decay": (_prefix("wd_", _exp), _set("training", weight_decay=_dbl)),
    "adam_betas": (lambda v: F.concat(F.lit("adam_b1_"), _part(0, "string")(v), F.lit("_b2_"), _part(1, "string")(v)), _set("training", beta1=_part(0, "double"), beta2=_part(1, "double"))),
    "lora_rank": (_prefix("lora_r"), _set("lora", r=_int, enabled=_lit(True))),
    "lora_alpha": (_prefix("lora_alpha"), _set("lora", lora_alpha=_int, enabled=_lit(True))),
    "lora_dropout": (_prefix("lora_dropout"), _set("lora", lora_dropout=_dbl, enabled=_lit(True))),
    "data_filter": (lambda v: F.concat(F.lit("filter_min"), _part(0, "string")(v), F.when(_part(1, "int")(v) > 0, F.concat(F.lit("_max"), _part(1, "string")(v))).otherwise(""), F.when(F.coalesce(_part(2, "boolean")(v), F.lit(True)), "_dedupe").otherwise("")), _set("data", min_len=_part(0, "int"), max_len=lambda v: F.when(_part(1, "int")(v) > 0, _part(1, "int")(v)), dedupe=lambda v: F.coalesce(_part(2, "boolean")(v), F.lit(True)))),
    "conversation_format": (_prefix("conv_"), _set("data", conversation_format=_choice("format", FORMATS))),
    "curriculum": (lambda v: F.concat(F.lit("curriculum_"), _part(0, "string")(v), F.lit("_"), _part(1, "string")(v), F.lit("_"), _part(2, "string")(v), F.lit("stages")), _set("data", curriculum=lambda v: F.struct(F.lit(True).alias("enabled"), _choice("strategy", STRATEGIES)(_part(0, "string")(v)).alias("strategy"), _choice("schedule", SCHEDULES)(_part(1, "string")(v)).alias("schedule"), _part(2, "int")(v).alias("num_stages")))),
    "constitution": (lambda v: F.concat(F.lit("constitution_"), F.regexp_extract(v, r"([^/]+?)(?:\.[^./]*)?$", 1)), _set("data", constitution=lambda v: F.struct(F.lit(True).alias("enabled"), v.alias("path")))),
}


def baseline(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """Configurations as rows; what a row leaves out has its default."""
    out = []
    for r in rows or [{"name": "baseline", "training": {"seed": 1337}}]:
        full = {k: r.get(k) for k in ("name", "run_id", "_metadata")}
        for section, defaults in DEFAULTS.items():
            full[section] = {**defaults, **(r.get(section) or {})}
        out.append(full)
    return spark.createDataFrame(out, SCHEMA)


def mutate(configs: DataFrame, kind: str, variants: list[str], timestamp: str | None = None) -> DataFrame:
    """One row for each configuration and variant, with where it came from.

    Variants are strings; those of two or three values have commas. Unknown
    variants raise. The configurations are a short list, as are the variants.
    """
    if kind not in MUTATIONS:
        raise ValueError(f"Unknown mutation type: {kind}")
    name, fields = MUTATIONS[kind]
    asked = configs.sparkSession.createDataFrame([(v,) for v in variants], "_variant string")
    v = F.col("_variant")
    out = configs.crossJoin(F.broadcast(asked))  # two short lists
    made: dict[str, Column] = {}
    for path, value in fields.items():
        section, field = path.split(".")
        made[section] = made.get(section, F.col(section)).withField(field, value(v))
    meta = F.struct(F.col("name").alias("parent_config"), F.lit(kind).alias("mutation_type"), v.alias("variant"), F.lit(timestamp).cast("string").alias("timestamp"), (F.coalesce(F.col("_metadata.generation"), F.lit(0)) + 1).cast("int").alias("generation"))
    return out.select([name(v).alias("name") if c == "name" else meta.alias(c) if c == "_metadata" else made[c].alias(c) if c in made else F.col(c) for c in configs.columns])


def read_yaml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Configurations of YAML files; the name defaults to the file's.

    ``6e-4`` is text to YAML; numbers are cast where the schema wants them.
    """
    import yaml

    rows = []
    for p in paths:
        raw = yaml.safe_load(Path(p).read_text()) or {}
        raw.setdefault("name", Path(p).stem)
        for section in ("model_args", "training"):
            for k, v in (raw.get(section) or {}).items():
                if isinstance(v, str):
                    try:
                        raw[section][k] = float(v)
                    except ValueError:
                        pass
        rows.append(raw)
    return baseline(spark, rows)


def write_yaml(configs: DataFrame, folder: str) -> list[str]:
    """One ``name.yaml`` a row, null fields left out; for grids, which are short."""
    import yaml

    def bare(x):
        return {k: bare(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x

    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for r in configs.toLocalIterator():
        path = Path(folder) / f"{r['name']}.yaml"
        path.write_text(yaml.safe_dump(bare(r.asDict(recursive=True)), sort_keys=False))
        out.append(str(path))
    return out


# Public model shapes.
ZOO = [
    ("llama3-8b", 4096, 32, 8, 32, 128256, 8192), ("llama3-1b", 2048, 32, 8, 16, 128256, 8192), ("mistral-7b", 4096, 32, 8, 32, 32000, 32768), ("qwen2-7b", 3584, 28, 4, 28, 152064, 32768),
]


def zoo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZOO, "name string, n_embd int, n_head int, n_kv_head int, n_layer int, vocab_size int, block_size int")


def from_public(shapes: DataFrame) -> DataFrame:
    """Model fields of public configurations, missing ones by default."""
    has = set(shapes.columns)
    pick = lambda c, other: F.coalesce(F.col(c), other) if c in has else other
    return shapes.select(
        pick("max_position_embeddings", F.lit(2048)).alias("block_size"), F.col("vocab_size"), F.col("num_hidden_layers").alias("n_layer"), F.col("num_attention_heads").alias("n_head"),
        pick("num_key_value_heads", F.col("num_attention_heads")).alias("n_kv_head"), F.col("hidden_size").alias("n_embd"),
    )
