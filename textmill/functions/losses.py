"""Losses, masks, routing and positions as expressions over arrays and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import let


def log_sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def dpo_loss(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    z = ((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)) * beta
    return -log_sigmoid(z) * (1 - smoothing) - log_sigmoid(-z) * smoothing


def log_softmax(logits: Column) -> Column:
    def of(top: Column) -> Column:
        total = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double"))))
        return let(total, lambda z: F.transform(logits, lambda x: (x - top).cast("double") - z))

    return let(F.array_max(logits), of)


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.get(log_softmax(logits), label)


def focal_loss(logits: Column, label: Column, alpha: float = 1.0, gamma: float = 2.0, ignore: int = -1) -> Column:
    """Ignored rows are 0 and stay in the mean."""
    ce = F.when(label == ignore, 0.0).otherwise(cross_entropy(logits, label))
    return let(ce, lambda x: F.pow(1 - F.exp(-x), F.lit(gamma)) * alpha * x)


def smoothed_loss(logits: Column, label: Column, smoothing: float = 0.1, ignore: int = -1) -> Column:
    """Ignored rows are null and leave the mean."""
    def of(lp: Column) -> Column:
        mean = F.aggregate(lp, F.lit(0.0), lambda a, x: a - x) / F.size(lp)
        return F.when(label != ignore, -F.get(lp, label) * (1 - smoothing) + mean * smoothing)

    return let(log_softmax(logits), of)


def token_log_prob(logits: Column, labels: Column) -> Column:
    """Sum of the log-probabilities of the next tokens of a sequence."""
    steps = F.zip_with(F.slice(logits, 1, F.size(logits) - 1), F.slice(labels, 2, F.size(labels)), lambda row, y: F.get(log_softmax(row), y))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def top_k_route(logits: Column, k: int) -> Column:
    """Array of (expert, weight): the k largest of a softmax, to sum 1; ties go to lower experts."""
    p = F.transform(log_softmax(logits), lambda x: F.exp(x))
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("expert"))))

    def of(top: Column) -> Column:
        total = F.aggregate(top, F.lit(0.0), lambda a, s: a - s["n"])
        return let(total, lambda z: F.transform(top, lambda s: F.struct(s["expert"].alias("expert"), (-s["n"] / z).alias("weight"))))

    return let(F.slice(ranked, 1, k), of)


def mask(spark: SparkSession, n: int, keep) -> DataFrame:
    """``(i, j)`` of a mask: for each i the j that ``keep(i)`` gives as an array."""
    return spark.range(n).withColumn("i", F.col("id").cast("int")).select("i", F.explode(keep(F.col("i"))).alias("j"))


def sliding_window(window: int):
    return lambda i: F.sequence(F.greatest(F.lit(0), i - window + 1), i)


def sparse_window(block: int, stride: int):
    """The own block back to ``block`` positions, and every ``stride``-th before."""
    return lambda i: F.array_sort(F.array_union(F.sequence(F.greatest(F.lit(0), i - block + 1), i), F.filter(F.sequence(F.lit(0), i), lambda j: j % stride == 0)))


def alibi_slopes(heads: int) -> list[float]:
    """Geometric slopes; for a count that is no power of two, those of the next lower one and every other of the next."""
    def power(n: int) -> list[float]:
        return [2 ** (-8 * (k + 1) / n) for k in range(n)]

    low = 2 ** int(math.log2(heads))
    return power(low) if low == heads else power(low) + power(2 * low)[0::2][: heads - low]


def alibi_bias(slope: Column, i: Column, j: Column) -> Column:
    return -F.abs(i - j) * slope


def rotate(vector: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary encoding of a vector of even length at a position."""
    half = F.floor(F.size(vector) / 2).cast("int")
    angle = lambda k: position * F.pow(F.lit(theta), -2.0 * k / F.size(vector))
    first = F.transform(F.slice(vector, F.lit(1), half), lambda x, k: x * F.cos(angle(k)) - F.get(vector, k + half) * F.sin(angle(k)))
    second = F.transform(F.slice(vector, half + 1, half), lambda x, k: x * F.cos(angle(k)) + F.get(vector, k) * F.sin(angle(k)))
    return F.concat(first, second)


def rms_norm(vector: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(vector)
    return let(F.sqrt(mean + eps), lambda s: F.transform(vector, lambda x: x / s))


def layer_norm(vector: Column, eps: float = 1e-5) -> Column:
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(vector)

    def of(m: Column) -> Column:
        var = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") - m, F.lit(2.0))) / F.size(vector)
        return let(F.sqrt(var + eps), lambda s: F.transform(vector, lambda x: (x - m) / s))

    return let(mean, of)


def top_k_logits(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become minus infinity; ties with it stay."""
    def of(edge: Column) -> Column:
        return F.transform(logits, lambda x: F.when(x < edge, F.lit(float("-inf"))).otherwise(x))

    return let(F.element_at(F.slice(F.sort_array(logits, asc=False), 1, k), -1), of)
