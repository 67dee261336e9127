"""Prompts for synthetic data and parsing of what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.operators.preference import generate, pick
from textmill.runtime import materialize

# The prompts.
SELF_INSTRUCT_HEAD = "Below are instruction-response pairs. Generate a new instruction-response pair following the same style.\n\nExamples:\n"
SELF_INSTRUCT_TAIL = "\n\nNew instruction-response pair:\nInstruction:"
EVOLUTIONS = {
    "add_constraints": ("Rewrite this instruction by adding 2-3 additional constraints or requirements:\n\n", "\n\nRewritten instruction:"),
    "deepen": ("Make this instruction require deeper reasoning or more steps:\n\n", "\n\nDeepened instruction:"),
    "concretize": ("Make this instruction more specific with concrete examples:\n\n", "\n\nConcrete instruction:"),
    "increase_reasoning": ("Rewrite to require multi-step reasoning:\n\n", "\n\nReasoning instruction:"),
}
DIFFICULTIES = {"easy": "single-step, basic", "medium": "multi-step, requires planning", "hard": "complex, requires advanced reasoning"}
TOPICS = ["arithmetic", "algebra", "geometry", "word_problems"]


def self_instruct_prompt(examples: Column) -> Column:
    """Prompt of an array of (instruction, response) structs."""
    shown = F.transform(examples, lambda e: F.concat(F.lit("Instruction: "), e["instruction"], F.lit("\nResponse: "), e["response"]))
    return F.concat(F.lit(SELF_INSTRUCT_HEAD), F.array_join(shown, "\n\n"), F.lit(SELF_INSTRUCT_TAIL))


def evolution_prompt(instruction: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (head, tail) in EVOLUTIONS.items():
        out = F.when(kind == name, F.concat(F.lit(head), instruction, F.lit(tail))).otherwise(out)
    return out


def math_prompt(difficulty: Column, topic: Column) -> Column:
    words = F.lit(None).cast("string")
    for name, text in DIFFICULTIES.items():
        words = F.when(difficulty == name, F.lit(text)).otherwise(words)
    return F.concat(F.lit("Generate a "), words, F.lit(" "), topic, F.lit(" math problem with step-by-step solution.\n\nProblem:"))


def parse_instruction(generated: Column) -> Column:
    """Struct (instruction, response), or null without ``Response:``."""
    parts = F.split(generated, r"\QResponse:\E", 2)
    left = tx.strip(F.replace(F.get(parts, F.lit(0)), F.lit("Instruction:"), F.lit("")))
    return F.when(F.contains(generated, F.lit("Response:")), F.struct(left.alias("instruction"), tx.strip(F.get(parts, F.lit(1))).alias("response")))


def parse_math(generated: Column) -> Column:
    """Struct (problem, solution, answer), or null where a part is missing.

    Text after a second ``Solution:`` or ``Answer:`` is cut off; an answer
    before the solution makes the text unusable.
    """
    parts = F.split(generated, r"\QSolution:\E", -1)
    after = F.split(F.get(parts, F.lit(1)), r"\QAnswer:\E", -1)
    whole = F.contains(generated, F.lit("Solution:")) & F.contains(generated, F.lit("Answer:")) & (F.size(after) > 1)
    return F.when(whole, F.struct(
        tx.strip(F.get(parts, F.lit(0))).alias("problem"), tx.strip(F.get(after, F.lit(0))).alias("solution"), tx.strip(F.get(after, F.lit(1))).alias("answer")))


def continuation(generated: Column, prompt: Column) -> Column:
    return F.substring(generated, F.length(prompt) + 1, F.length(generated))


def self_instruct(seeds: DataFrame, num_samples: int, make_generator, shots: int = 3, seed: int = 0) -> DataFrame:
    """``(id, instruction, response)`` from prompts of sampled seed tasks.

    ``seeds(instruction, response)`` is a short list of tasks: it is collected
    into the prompts, at most 10,000 of them. Which tasks a prompt shows
    depends on its number and the seed.
    """
    spark = seeds.sparkSession
    tasks = [(r["instruction"], r["response"]) for r in seeds.select("instruction", "response").limit(10_001).collect()]
    if len(tasks) > 10_000:
        raise ValueError("seed tasks are a short list")
    if not tasks:
        return spark.createDataFrame([], "id long, instruction string, response string")
    bank = F.array(*[F.struct(F.lit(i).alias("instruction"), F.lit(r).alias("response")) for i, r in tasks])
    n = min(shots, len(tasks))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(tasks) - 1)), lambda k: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), k.cast("string"))).alias("key"), k.alias("k"))))
    rows = spark.range(num_samples).withColumn("prompt", self_instruct_prompt(F.transform(F.slice(order, 1, n), lambda o: F.get(bank, o["k"]))))
    done = rows.join(generate(rows, "id", "prompt", make_generator, "text"), "id").withColumn("p", parse_instruction(continuation(F.col("text"), F.col("prompt"))))
    return done.where("p is not null").select("id", "p.instruction", "p.response")


def evol_instruct(base: DataFrame, id_col: str, iterations: int, make_generator, sample: int = 100, seed: int = 0) -> DataFrame:
    """``(id_col, round, kind, instruction, response)``: the base and what evolved of it.

    Each round evolves ``sample`` tasks of all there are; the response is kept.
    """
    have = base.select(F.col(id_col).cast("string").alias(id_col), F.lit(0).alias("round"), F.lit(None).cast("string").alias("kind"), "instruction", "response")
    for k in range(1, iterations + 1):
        chosen = have.orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}:{k}"), F.col(id_col)))).limit(sample)
        kind = pick(list(EVOLUTIONS), F.col(id_col), seed + k)
        asked = chosen.select(F.concat(F.col(id_col), F.lit(f"/{k}")).alias(id_col), F.lit(k).alias("round"), kind.alias("kind"), "response", evolution_prompt(F.col("instruction"), kind).alias("prompt"))
        new = asked.join(generate(asked, id_col, "prompt", make_generator, "text"), id_col).withColumn("instruction", tx.strip(continuation(F.col("text"), F.col("prompt"))))
        # written, so that the parents of a later round are the rows that come out
        have = have.unionByName(materialize(new.select(id_col, "round", "kind", "instruction", "response"), "evolved"))
    return have


def math_problems(spark, num: int, make_generator, difficulty: str = "medium", topics: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``(id, problem, solution, answer)`` of generated texts that parse."""
    rows = spark.range(num).withColumn("prompt", math_prompt(F.lit(difficulty), pick(topics or TOPICS, F.col("id"), seed)))
    done = rows.join(generate(rows, "id", "prompt", make_generator, "text"), "id").withColumn("p", parse_math(continuation(F.col("text"), F.col("prompt"))))
    return done.where("p is not null").select("id", "p.problem", "p.solution", "p.answer")
