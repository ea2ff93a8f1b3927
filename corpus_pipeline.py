"""A corpus pipeline: what each stage keeps is written and read again as the next one's documents.

Every stage takes absent ids and texts, empty and very long texts, rows that
occur several times, empty tables and further columns, which it hands on (but
the last, which returns tokens); a column whose name the stage needs for
itself stays as it is.  An absent text is scored as an empty one, fails the
quality rules, and is linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvelake.llm import common, jaccard, merge_dropout, mixing, quality_rules, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier, trained on the labelled ones, does not call toxic."""
    model = toxicity.train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose counts and compression ratios pass."""
    return quality_rules.keep(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of smallest id, absent ids last, and of rows alike in id the one of smallest class key and text."""
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights and shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, which each copy of a document draws for itself: rows alike are numbered."""
    copy = common.free("copy", docs.columns)
    return merge_dropout.encode(common.numbered(docs, copy), copy_col=copy)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained dictionaries and zstandard ratios have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs)
    return docs
