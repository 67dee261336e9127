"""Scoring of benchmark outputs: prompts, answer extraction, accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx

# Fixed values.
TASK_METRICS = {"gsm8k": "accuracy", "mmlu": "accuracy", "humaneval": "pass_at_1", "constitution": "preference_accuracy"}
HELPFUL_LENGTH, UNHELPFUL_START = 20, "I cannot"


def gsm8k_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def gsm8k_gold(answer: Column) -> Column:
    """What follows the last ``####``, without blanks and commas."""
    return F.replace(tx.strip(F.substring_index(answer, "####", -1)), F.lit(","), F.lit(""))


def mmlu_prompt(question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c, F.lit("\n")))
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("Answer:"))


def extract_number(text: Column) -> Column:
    """The last ``#### n``, else the last ``answer is/equals n``, else the last number.

    Commas go; a full stop right behind the digits stays with them, as in
    ``answer is 42.``
    """
    def last(c: Column, pattern: str) -> Column:
        return tx.let(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda found: F.when(F.size(found) > 0, F.element_at(found, -1)))

    # \b by Unicode: neither side may be a letter, mark, digit or underscore
    alone = r"(?U)\b([0-9,\.]+)\b"
    ways = [last(text, rf"####[{tx.SPACE}]*([0-9,\.]+)"), last(F.lower(text), rf"(?:answer is|equals?)[{tx.SPACE}]*([0-9,\.]+)"), last(text, alone)]
    return F.replace(F.coalesce(*ways), F.lit(","), F.lit(""))


def extract_choice(text: Column) -> Column:
    """The first letter A to D that stands alone, small ones included."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(?U)\b([A-D])\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.get(found, F.lit(0)))


def accuracy(df: DataFrame, predicted: Column, gold: Column, by: list[str] | None = None) -> DataFrame:
    """Correct, total and their share; empty or null predictions are wrong; 0 over none."""
    right = F.coalesce((predicted == gold) & (F.length(predicted) > 0), F.lit(False))
    return df.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(right.cast("int")), F.lit(0)).cast("long").alias("correct"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def pass_rate(df: DataFrame, passed: Column, by: list[str] | None = None) -> DataFrame:
    """pass@1 of outcomes that a sandbox has given; code is never run here."""
    ok = F.coalesce(passed, F.lit(False))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.sum(ok.cast("int")), F.lit(0)).cast("long").alias("passed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("pass_at_1"))


def is_helpful(response: Column) -> Column:
    body = tx.strip(response)
    return F.coalesce((F.length(body) > HELPFUL_LENGTH) & ~F.startswith(body, F.lit(UNHELPFUL_START)), F.lit(False))


def aggregate_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over the tasks' own metrics and how many tasks have one.

    ``results(task, metric, value)``; other metrics, and rows that are an error
    (null value), don't count. NaN is a value.
    """
    named = F.lit(False)
    for task, metric in TASK_METRICS.items():
        named = named | ((F.col("task") == task) & (F.col("metric") == metric))
    return results.where(named & F.col("value").isNotNull()).groupBy(*(by or [])).agg(F.avg("value").alias("mean_score"), F.count(F.lit(1)).alias("num_tasks"))


def first_items(df: DataFrame, pos_col: str, max_samples: int | None) -> DataFrame:
    """Items before ``max_samples`` in their 0-based order; none or 0 is all."""
    return df.where(F.col(pos_col) < max_samples) if max_samples else df


def mean_loss(df: DataFrame, loss_col: str, order_col: str, max_iters: int = 100) -> DataFrame:
    """Mean loss and perplexity of the first batches; infinite over none."""
    head = df.orderBy(order_col).limit(max_iters)
    return head.agg(F.coalesce(F.avg(loss_col), F.lit(float("inf"))).alias("loss")).withColumn("perplexity", F.exp("loss"))


def gold_join(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    return predictions.join(gold, key)


def benchmark_suite(predictions: DataFrame) -> DataFrame:
    """``(task, metric, value, error)`` of a table of predictions, and the aggregate.

    ``predictions(task, prediction, gold, passed, score)``: choices and numbers
    are compared, code outcomes counted, preference scores signed. An unknown
    task has an error and no value.
    """
    right = F.coalesce((F.col("prediction") == F.col("gold")) & (F.length("prediction") > 0), F.lit(False))
    hit = F.when(F.col("task").isin("gsm8k", "mmlu"), right).when(F.col("task") == "humaneval", F.coalesce("passed", F.lit(False))).when(F.col("task") == "constitution", F.coalesce(F.col("score") > 0, F.lit(False)))
    metric = F.lit(None).cast("string")
    for task, name in TASK_METRICS.items():
        metric = F.when(F.col("task") == task, F.lit(name)).otherwise(metric)
    each = predictions.groupBy("task").agg(F.avg(hit.cast("double")).alias("value")).select("task", metric.alias("metric"), "value", F.when(metric.isNull(), F.concat(F.lit("Unknown task: "), F.col("task"))).alias("error"))
    whole = aggregate_metrics(each).select(F.lit("aggregate").alias("task"), F.lit("mean_score").alias("metric"), F.col("mean_score").alias("value"), F.lit(None).cast("string").alias("error"))
    return each.unionByName(whole)
