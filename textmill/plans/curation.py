"""Queries over texts: scores, pipeline, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import quality as ql
from textmill.functions import text as tx
from textmill.operators import dedup, filtering

NAMES = [s.name for s in ql.default_scores()]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _score(build: ql.Score):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = F.col("text")
        return documents(spark, d).select("doc_id", F.round(F.when(c.isNotNull(), build.build(c)), 6).alias("score"))

    return query


def q_length_hard(spark: SparkSession, d: str) -> DataFrame:
    return filtering.hard_length(documents(spark, d), "text", 50, 2000).select("doc_id")


def q_entropy(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", F.round(ql.entropy(F.col("text")), 6).alias("entropy"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return filtering.evaluate(documents(spark, d))


def q_filter_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("doc_id", "passed", F.array_join("failed_filters", ",").alias("failed_filters"))


def _shown(stats: DataFrame, by: list[str]) -> DataFrame:
    return stats.select(*by, "total", "passed", "failed", F.round("pass_rate", 6).alias("pass_rate"), *[f"rejected_{n}" for n in NAMES], *[F.round(f"mean_{n}", 6).alias(f"mean_{n}") for n in NAMES])


def q_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return _shown(filtering.stats(_evaluated(spark, d), NAMES), [])


def q_reject_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _shown(filtering.stats(_evaluated(spark, d), NAMES, ["lang"]), ["lang"])


def q_logged_rejections(spark: SparkSession, d: str) -> DataFrame:
    """The logged decisions by source and filter, each sample once."""
    log = spark.read.parquet(f"{d}/filter_results.parquet").select("sample_id", "source", "passed", "failed_filters").distinct()
    each = log.select("source", F.explode_outer("failed_filters").alias("filter"), "passed")
    return each.groupBy("source", "filter").agg(F.count(F.lit(1)).alias("samples"), F.count_if("passed").alias("passed"))


def curated_documents(spark: SparkSession, d: str) -> DataFrame:
    """By language: documents, those that pass, and those that also are first copies."""
    done = dedup.first_copies(_evaluated(spark, d), "text", "doc_id")
    return done.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if("passed").alias("passed"), F.count_if(F.col("passed") & F.col("first")).alias("kept"))


def q_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedupe(documents(spark, d), "text", "doc_id").select("doc_id")


def q_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    named = documents(spark, d).where("text is not null").select("doc_id", dedup.digest(F.col("text")).alias("digest"))
    return named.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def q_dedup_seen(spark: SparkSession, d: str) -> DataFrame:
    """Logged samples that are no document's text."""
    seen = documents(spark, d).where("text is not null").select(dedup.digest(F.col("text")).alias("digest"))
    log = spark.read.parquet(f"{d}/filter_results.parquet").select("sample_id", "sample").distinct()
    return dedup.unseen(log, "sample", seen).select("sample_id")


def q_digests(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return documents(spark, d).select("doc_id", dedup.digest(c).alias("sha256"), dedup.digest(c, "md5").alias("md5"), dedup.digest(c, "sha1").alias("sha1"))


def q_minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    from textmill.runtime import materialize

    return dedup.similar_pairs(materialize(dedup.minhash(documents(spark, d), "doc_id", "text"), "minhash"), "doc_id")


def q_minhash_keep(spark: SparkSession, d: str) -> DataFrame:
    return dedup.minhash_dedupe(documents(spark, d), "doc_id", "text").select("doc_id")


def q_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), tx.strip(F.col("text")).alias("stripped"))


S = tx.SPACE
WORDS = f"list_filter(regexp_split_to_array(text, '[{S}]+'), lambda w: w <> '')"
_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_ngram = lambda n: f"CASE WHEN len(w) >= {n} THEN (len(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))) / (len(w) - {n} + 1)) END"
_count = lambda cls: f"(length(text) - length(regexp_replace(text, '{cls}', '', 'g')))"
LENGTH = "CASE WHEN length(text) < 50 THEN length(text) / 50.0::DOUBLE WHEN length(text) > 100000 THEN 100000.0::DOUBLE / length(text) ELSE 1.0::DOUBLE END"
REPETITION = f"""CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE coalesce(least(
    CASE WHEN len(w) > 1 THEN len(list_distinct(w)) / len(w) END,
    CASE WHEN length(text) > 1 THEN (1 + len(list_filter(range(2, len(c) + 1), lambda i: c[i] <> c[i - 1]))) / len(c) END,
    {_ngram(2)}, {_ngram(3)}, {_ngram(4)}), 1.0::DOUBLE) END"""
CHARS = rf"""CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE least(
    (length(text) - ({_count(r"[\p{C}\p{Z}]")} - {_count(r"[ \n\t\r]")})) / length(text),
    {_count(rf"[\p{{L}}\p{{N}}{S}]")} / length(text) * 1.5::DOUBLE, 1.0::DOUBLE - {_count(r"\x00")} / length(text)) END"""
LANGUAGE = "greatest(" + ", ".join(f"least(1.0::DOUBLE, len(list_filter({_list(ws)}, lambda x: list_contains(lw, x))) / 5.0::DOUBLE)" for ws in ql.COMMON_WORDS.values()) + ")"
PERPLEXITY = "CASE WHEN length(text) < 10 THEN 0.5::DOUBLE WHEN h < 1.0 THEN 0.3::DOUBLE WHEN h > 5.0 THEN greatest(0.0::DOUBLE, 1 - (h - 5.0::DOUBLE) / 5.0::DOUBLE) ELSE 1.0::DOUBLE END"
URLS = f"""CASE WHEN length(text) = 0 THEN 1.0::DOUBLE WHEN u / length(text) <= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (u / length(text) - 0.3::DOUBLE) / 0.7::DOUBLE) END"""
D = rf"""WITH d AS (SELECT *, {WORDS} AS w, list_filter(regexp_split_to_array(lower(text), '[{S}]+'), lambda w: w <> '') AS lw,
    regexp_extract_all(text, '(?s).') AS c,
    list_sum(list_transform(regexp_extract_all(text, '{ql.LINK}'), lambda x: length(x))) AS u0 FROM documents),
e AS (SELECT doc_id, coalesce(sum(-k / n * log2(k / n)), 0.0) AS h FROM (
    SELECT doc_id, ch, count(*) AS k, any_value(n) AS n FROM (SELECT doc_id, length(text) AS n, unnest(regexp_extract_all(lower(text), '(?s).')) AS ch FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, ch) GROUP BY doc_id),
x AS (SELECT d.* EXCLUDE (u0), coalesce(u0, 0) AS u, coalesce(e.h, 0.0) AS h FROM d LEFT JOIN e USING (doc_id)),
s AS (SELECT doc_id, lang, text, {LENGTH} AS length, {REPETITION} AS repetition, {CHARS} AS char_distribution, {LANGUAGE} AS language, {PERPLEXITY} AS perplexity, {URLS} AS url_density FROM x)"""
THRESHOLDS = {s.name: s.threshold for s in ql.default_scores()}
_one = lambda n: D + f" SELECT doc_id, round(CASE WHEN text IS NOT NULL THEN {n} END, 6) AS score FROM s"
FAILS = ", ".join(f"CASE WHEN {n} < {t} THEN '{n}' END" for n, t in THRESHOLDS.items())
V = D + f""", v AS (SELECT *, CASE WHEN text IS NULL THEN ['null_text'] ELSE list_filter([{FAILS}], lambda x: x IS NOT NULL) END AS f FROM s)"""
_aggs = "count(*) AS total, count(*) FILTER (len(f) = 0) AS passed, count(*) FILTER (len(f) > 0) AS failed, round(count(*) FILTER (len(f) = 0) / count(*), 6) AS pass_rate, " + ", ".join(
    f"count(*) FILTER (list_contains(f, '{n}')) AS rejected_{n}, round(avg(CASE WHEN text IS NOT NULL THEN {n} END), 6) AS mean_{n}" for n in NAMES
)
DIGEST = "sha256(text)"

QUERIES = {
    "q_length_score": _score(ql.length(50, 100_000)), "q_repetition": _score(ql.repetition()), "q_char_distribution": _score(ql.char_distribution()), "q_language": _score(ql.language()),
    "q_perplexity": _score(ql.perplexity()), "q_url_density": _score(ql.url_density()), "q_length_hard": q_length_hard, "q_entropy": q_entropy, "q_word_counts": q_word_counts,
    "q_filter_pipeline": q_filter_pipeline, "q_filter_stats": q_filter_stats, "q_reject_by_lang": q_reject_by_lang, "q_logged_rejections": q_logged_rejections, "q_curated_documents": curated_documents,
    "q_exact_dedup": q_exact_dedup, "q_dup_groups": q_dup_groups, "q_dedup_seen": q_dedup_seen, "q_digests": q_digests, "q_minhash_pairs": q_minhash_pairs, "q_minhash_keep": q_minhash_keep,
}
ORACLES = {
    **{f"q_{'length_score' if n == 'length' else n}": _one(n) for n in NAMES},
    "q_length_hard": "SELECT doc_id FROM documents WHERE length(text) BETWEEN 50 AND 2000",
    "q_entropy": D + " SELECT doc_id, round(h, 6) AS entropy FROM x WHERE text IS NOT NULL",
    "q_word_counts": rf"SELECT doc_id, len({WORDS}) AS words, length(text) AS chars, regexp_replace(text, '^[{S}]+|[{S}]+\z', '', 'g') AS stripped FROM documents WHERE text IS NOT NULL",
    "q_filter_pipeline": V + " SELECT doc_id, len(f) = 0 AS passed, array_to_string(f, ',') AS failed_filters FROM v",
    "q_filter_stats": V + f" SELECT {_aggs} FROM v",
    "q_reject_by_lang": V + f" SELECT lang, {_aggs} FROM v GROUP BY lang",
    "q_logged_rejections": """WITH l AS (SELECT DISTINCT sample_id, source, passed, failed_filters FROM filter_results),
e AS (SELECT source, passed, unnest(CASE WHEN failed_filters IS NULL OR len(failed_filters) = 0 THEN [NULL] ELSE failed_filters END) AS filter FROM l)
SELECT source, filter, count(*) AS samples, count(*) FILTER (passed) AS passed FROM e GROUP BY source, filter""",
    "q_curated_documents": V + f""", k AS (SELECT *, text IS NULL OR row_number() OVER (PARTITION BY {DIGEST} ORDER BY doc_id) = 1 AS first FROM v)
SELECT lang, count(*) AS documents, count(*) FILTER (len(f) = 0) AS passed, count(*) FILTER (len(f) = 0 AND first) AS kept FROM k GROUP BY lang""",
    "q_exact_dedup": f"SELECT doc_id FROM documents QUALIFY text IS NULL OR row_number() OVER (PARTITION BY {DIGEST} ORDER BY doc_id) = 1",
    "q_dup_groups": f"SELECT {DIGEST} AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "q_dedup_seen": "SELECT DISTINCT sample_id FROM filter_results f WHERE sample IS NULL OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = f.sample)",
    "q_digests": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents",
}
