"""The registered queries of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language_id, line_dedup, near_dup, packing, preferences, quality_fm, quality_rules, ranked_search, resample, secrets, sharding, token_counts
from quarry.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary's file; QUARRY_TOKENIZERS names another folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("reasons")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.examples(table(spark, sf_dir, "conversations"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = secrets.spelled(F.filter("spans", lambda x: x["kind"] < len(secrets.BASE)))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.BASE)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), "m").select("doc_id", "m.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_language_id, op4_preference_format, op5_quality_classifier, op6_secrets, op7_simhash, op8_line_dedup, op9_packing, op10_decontamination, op11_ranked_search, op12_importance_resampling, op13_token_counts)}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality_rules.oracle_sql(), "op4_preference_format": preferences.oracle_sql(), "op8_line_dedup": line_dedup.oracle_sql(), "op11_ranked_search": ranked_search.oracle_sql()}
