"""Analytics over training logs: best and last values, rankings, curves."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.curriculum import global_rank, rank_within

METRIC_LINE = r"train loss ([\d.]+).*val loss ([\d.]+)"


def once(log: DataFrame, keys: tuple[str, ...] = ("run_id", "iter"), arrived: str = "ingested_at") -> DataFrame:
    """One row for each key: the one that arrived last; ties are equal copies."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrived).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def best_val_loss(log: DataFrame, by: list[str], order_col: str = "iter") -> DataFrame:
    """The first least ``val_loss`` of each group and its step; NaN and null don't count.

    A step without number is step 0. Groups without a value give no row.
    """
    ok = log.where(F.col("val_loss").isNotNull() & ~F.isnan("val_loss"))
    return ok.groupBy(*by).agg(F.min(F.struct("val_loss", F.coalesce(F.col(order_col), F.lit(0)).alias("at"))).alias("m")).select(*by, F.col("m.val_loss").alias("best_val_loss"), F.col("m.at").alias("best_iter"))


def last_metrics(log: DataFrame, by: list[str], cols: list[str], order_col: str = "iter") -> DataFrame:
    """The last row of each group."""
    return log.groupBy(*by).agg(F.max_by(F.struct(order_col, *cols), order_col).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in [order_col, *cols]])


def has_val(log: DataFrame) -> DataFrame:
    return log.where(F.col("val_loss").isNotNull())


def sweep_rank(runs: DataFrame, name_col: str, score_col: str | None = None, loss_col: str = "val_loss", status_col: str = "status", by: list[str] | None = None) -> DataFrame:
    """Successful runs with their rank: by score falling (none is 0), else by loss rising.

    Ties rank by name. Runs that failed or have no loss are left out. A group of
    ``by`` is a sweep, whose runs fit a task; without it the whole table is
    ranked in ranges.
    """
    ok = runs.where((F.col(status_col) == "success") & F.col(loss_col).isNotNull())
    key = F.desc(F.coalesce(F.col(score_col), F.lit(0.0))) if score_col else F.asc(loss_col)
    if not by:
        return global_rank(ok, [key, F.asc(name_col)]).withColumn("rank", F.col("rank") + 1)
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key, F.asc(name_col))))


def compare(base_loss: Column, other_loss: Column) -> Column:
    """Struct (improvement_pct, mutation_wins); null where a loss is null or 0."""
    ok = (base_loss != 0) & (other_loss != 0)
    return F.when(ok, F.struct(((base_loss - other_loss) / base_loss * 100).alias("improvement_pct"), (other_loss < base_loss).alias("mutation_wins")))


def scrape_log(lines: DataFrame, text_col: str = "value", order_col: str = "line_no", by: list[str] | None = None) -> DataFrame:
    """Train and val loss of the last line that has both."""
    hit = lines.where(F.col(text_col).rlike(METRIC_LINE)).select(*(by or []), order_col, *[F.regexp_extract(text_col, METRIC_LINE, i).cast("double").alias(n) for i, n in ((1, "train_loss"), (2, "val_loss"))])
    return last_metrics(hit, by or [], ["train_loss", "val_loss"], order_col)


def learning_rate(it: Column, lr: float, min_lr: float, warmup: int, decay: int) -> Column:
    """Linear warmup, cosine decay, then the floor."""
    ratio = (it - warmup) / F.lit(float(decay - warmup)) if decay > warmup else F.lit(1.0)
    cosine = F.lit(min_lr) + (F.cos(ratio * math.pi) + 1) * 0.5 * (lr - min_lr)
    return F.when(it < warmup, (it + 1) * lr / (warmup + 1)).when(it > decay, min_lr).otherwise(cosine)


def ema(log: DataFrame, by: list[str], value_col: str, order_col: str = "iter", beta: float = 0.98, chunk: int = 128) -> DataFrame:
    """``by, order_col, value, ema``: bias-corrected running mean of each group.

    A long series is cut into chunks that are folded side by side; then the
    chunks' ends, one row each, are folded, and each chunk gets what the ones
    before it carry over. So no task folds a whole series row by row, and there
    are no powers that overflow. Chunks so far back that their share is below
    1e-18 are not carried. Null values are left out.
    """
    rows = log.where(F.col(value_col).isNotNull()).select(*by, F.col(order_col).alias("_o"), F.col(value_col).cast("double").alias("_v"))
    numbered = rank_within(rows, by, [F.asc("_o")], "_t").withColumn("_chunk", F.floor(F.col("_t") / chunk))
    part = numbered.groupBy(*by, "_chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_o").alias("o"), F.col("_v").alias("v")))).alias("_xs"))
    start = F.array().cast("array<struct<t:int,o:bigint,v:double,a:double>>")

    def push(acc: Column, x: Column) -> Column:
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["a"]).otherwise(0.0)
        return F.concat(acc, F.array(F.struct(x["t"].cast("int").alias("t"), x["o"].cast("bigint").alias("o"), x["v"].alias("v"), (before * beta + x["v"] * (1 - beta)).alias("a"))))

    folded = part.withColumn("_xs", F.aggregate("_xs", start, push)).withColumn("_end", F.element_at("_xs", -1)["a"])
    felt = max(1, math.ceil(18 * math.log(10) / (-math.log(beta) * chunk))) if 0 < beta < 1 else 1
    order = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(-felt, -1)
    ends = F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("c"), F.col("_end").alias("e"))).over(order))
    carry = F.aggregate(ends, F.lit(0.0), lambda a, x: a * (beta**chunk) + x["e"])
    carried = folded.withColumn("_carry", carry).select(*by, "_chunk", "_carry", F.explode("_xs").alias("_x"))
    a = F.col("_x.a") + F.col("_carry") * F.pow(F.lit(beta), F.col("_x.t") - F.col("_chunk") * chunk + 1)
    return carried.select(*by, F.col("_x.o").alias(order_col), F.col("_x.v").alias("value"), (a / (1 - F.pow(F.lit(beta), F.col("_x.t") + 1))).alias("ema"))


#: Rows of a stretch of a curve.
STRETCH = 4096


def _stretches(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` in stretches of each group, with the neighbours of their ends.

    ``_home`` marks the rows of a stretch itself; each row is home in one.
    """
    numbered = rank_within(df, by, [F.asc(order)], "_t").withColumn("_own", F.floor(F.col("_t") / STRETCH))
    edge = F.col("_t") % STRETCH
    also = F.when((edge == 0) & (F.col("_t") > 0), F.array(F.col("_own") - 1)).when(edge == STRETCH - 1, F.array(F.col("_own") + 1)).otherwise(F.array().cast("array<bigint>"))
    return numbered.withColumn("_part", F.explode(F.concat(F.array("_own"), also))).withColumn("_home", F.col("_part") == F.col("_own"))


def gradient(df: DataFrame, by: list[str], x: str, y: str, order: str) -> DataFrame:
    """``df`` with ``slope``: second-order differences on an uneven grid, one-sided at the ends.

    Works on stretches of a group, so one task never has a whole curve.
    """
    w = Window.partitionBy(*by, "_part").orderBy("_t")
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    back, ahead = F.col(y) - F.lag(y).over(w), F.lead(y).over(w) - F.col(y)
    inner = (hs * hs * F.lead(y).over(w) + (hd * hd - hs * hs) * F.col(y) - hd * hd * F.lag(y).over(w)) / (hs * hd * (hs + hd))
    sloped = _stretches(df, by, order).withColumn("slope", F.when(hs.isNull(), ahead / hd).when(hd.isNull(), back / hs).otherwise(inner))
    return sloped.where("_home").select(*df.columns, "slope")


def until_divergence(df: DataFrame, by: list[str], loss: str, step: str, factor: float = 4.0, grace: int = 10) -> DataFrame:
    """Steps up to and with the first that is NaN, infinite or far above the best.

    The best so far is that of the stretches before and of the rows before in
    the own one; only one row a stretch meets the others of its group.
    """
    rows = rank_within(df, by, [F.asc(step)], "_t").withColumn("_part", F.floor(F.col("_t") / STRETCH))
    v = F.col(loss)
    sound = F.when(~F.isnan(v), v)
    ends = rows.groupBy(*by, "_part").agg(F.min(sound).alias("_least"))
    before = ends.withColumn("_before", F.min("_least").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    own = F.min(sound).over(Window.partitionBy(*by, "_part").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    keys = [*by, "_part"]
    met = rows.join(before.withColumnsRenamed({k: f"_b{k}" for k in keys}), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys]))
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | ((v > F.least(own, F.col("_before")) * factor) & (F.col(step) > grace))
    judged = met.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    stop = judged.where("_bad").groupBy(*[F.col(k).alias(f"_s{k}") for k in by]).agg(F.min("_t").alias("_end"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in by]) if by else F.lit(True)
    return judged.join(stop, same, "left").where(F.col("_end").isNull() | (F.col("_t") <= F.col("_end"))).select(*df.columns)


def lr_finder(df: DataFrame, by: list[str], lr: str, loss: str, step: str) -> DataFrame:
    """Suggested, steepest and least-loss rates of each sweep of rates.

    The steepest is the first least slope of loss over log10 of the rate, the
    suggestion a tenth of it. Fewer than three points give the least rate.
    """
    sloped = gradient(df.withColumn("_x", F.log10(F.col(lr))), by, "_x", loss, step)
    out = sloped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.min(lr).alias("_low"), F.min(F.struct(F.col("slope"), F.col(step), F.col(lr).alias("lr"))).alias("_s"), F.min(F.struct(F.col(loss), F.col(step), F.col(lr).alias("lr"))).alias("_m")
    )
    few = F.col("points") < 3
    return out.select(*by, "points", F.when(few, F.col("_low")).otherwise(F.col("_s.lr") / 10).alias("suggested_lr"), F.when(few, F.col("_low")).otherwise(F.col("_s.lr")).alias("steepest_lr"), F.when(few, F.col("_low")).otherwise(F.col("_m.lr")).alias("min_loss_lr"))


def noise_scale(vectors: DataFrame, by: list[str], vector_col: str) -> DataFrame:
    """Gradient noise scale: n * sum |g|^2 / max(|sum g|^2, 1e-8) - 1."""
    norms = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq"))
    sums = vectors.select(*by, F.posexplode(vector_col).alias("_k", "_x")).groupBy(*by, "_k").agg(F.sum(F.col("_x").cast("double")).alias("_s")).groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("whole"))
    both = norms.join(sums, by) if by else norms.crossJoin(sums)
    return both.select(*by, "n", (F.col("n") * F.col("sq") / F.greatest("whole", F.lit(1e-8)) - 1).alias("noise_scale"))


def parameter_ema(values: Column, decay: float = 0.9999, first: Column | None = None) -> Column:
    """Shadow of a parameter after an array of its values: s = d*s + (1-d)*v.

    Starts from ``first``, or else from the first value.
    """
    start = (F.get(values, F.lit(0)) if first is None else first).cast("double")
    return F.aggregate(values, start, lambda s, v: s * decay + v.cast("double") * (1 - decay))


def mean_by_split(df: DataFrame, split_col: str, loss_col: str) -> DataFrame:
    """Mean loss and perplexity of each split."""
    return df.groupBy(split_col).agg(F.avg(loss_col).alias("loss"), F.count(loss_col).alias("batches")).withColumn("perplexity", F.exp("loss"))


def parameter_counts(params: DataFrame, size_col: str, trainable: Column) -> DataFrame:
    """One row: all and trainable parameters and the percentage; 0 over none."""
    n = F.coalesce(F.sum(size_col), F.lit(0)).cast("long")
    own = F.coalesce(F.sum(F.when(trainable, F.col(size_col))), F.lit(0)).cast("long")
    return params.agg(n.alias("total"), own.alias("trainable")).withColumn("percent", F.when(F.col("total") > 0, F.col("trainable") * 100.0 / F.col("total")).otherwise(0.0))


def utilisation(tokens: Column, seconds: Column, params: Column, layers: Column, width: Column, block: Column, peak_flops: float = 312e12) -> Column:
    """Share of the peak: 6 flops a parameter and token, and attention's 12*L*width*block."""
    return (params * 6 + layers * width * block * 12) * tokens / seconds / peak_flops


def write_report(df: DataFrame, path: str) -> None:
    """A report of a sweep or comparison as JSON lines, replaced as a whole."""
    df.write.mode("overwrite").json(path)
