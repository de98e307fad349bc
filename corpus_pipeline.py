"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage
before it returned, written and read again. All but the last return rows of documents
with their columns as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontam, exact_dedup, jaccard, langid, packing
from tallyforge.llm.common import table
from tallyforge.plans.scratch import drop_scratch, materialise, scratch_scope


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; texts that none of them fits go."""
    return langid.stay(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.stay(docs, exact_dedup.DigestIndex.scratch(spark))


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard.stay(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, copied or edited."""
    return decontam.stay(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece and its place in a sequence of at most 1024 tokens."""
    return packing.placements(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_shingles),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed_sequences),
]

#: SQL cannot express the language models, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage stored on its way is dropped when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch_scope() as made:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_scratch(spark, before + made[:-1])  # the last path is the result's own
        before = made[-1:]
    return docs
