"""A corpus pipeline of the training-data operators; each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voicelake.llm import bpe, mixing, neardup, quality, suffixdedup
from voicelake.llm.scratch import Scratch

#: Words a shingle; two, as in op9_neardup, would drop documents that are much less alike.
SHINGLE_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of SHINGLE_WORDS words."""
    return neardup.drop_near_duplicates(docs, SHINGLE_WORDS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that a repeated 200-byte string covers; n_chars follows the text."""
    return suffixdedup.cut_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the texts that are left."""
    return bpe.token_report(docs, bpe.vocabulary_file())


STAGES = [("quality rules", quality_stage), ("MinHash near-dedup", neardup_stage), ("suffix-array dedup", suffix_stage), ("mixing", mixing_stage), ("BPE", bpe_stage)]

#: Hashes and word tables of the stages have no SQL twin; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    names = [f"{place}-{name.replace(' ', '-')}" for place, (name, _) in enumerate(STAGES)]
    for name, (_, stage) in zip(names, STAGES, strict=True):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    scratch.drop_all(keep=names[-1])
    return docs
