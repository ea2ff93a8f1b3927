"""The operators bound to the test tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvelake.llm import common, crf, hamming, hmm, jaccard, merge_dropout, mixing, quality_rules, sharding, token_counts, toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(common.read(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(common.read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return crf.classify(docs, crf.train(docs, common.read(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(common.read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.read(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.where(hamming.every(rows)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(common.read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_lm_scores": op3_lm_scores,
        "op4_token_counts": op4_token_counts,
        "op5_quality": op5_quality,
        "op6_sharding": op6_sharding,
        "op7_mixing": op7_mixing,
        "op8_jaccard": op8_jaccard,
        "op9_topk": op9_topk,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": sharding.shards_sql(), "op7_mixing": mixing.mix_sql(), "op8_jaccard": jaccard.join_sql(), "op9_topk": hamming.top_k_sql()}
