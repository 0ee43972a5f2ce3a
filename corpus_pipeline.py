"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, line_dedup, quality, sentencepiece_codec, simhash
from latticework.llm.common import materialize


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the lines that too many documents of a host share."""
    return _counted(quality.apply_rules(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go everywhere."""
    return _counted(line_dedup.dedup_lines(docs, policy="frequent", min_docs=10))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word similarity of 0.8 or more one stays."""
    return simhash.one_of_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the text they decode to, and the span of each id in the text."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("simhash near-dedup", simhash_stage), ("benchmark decontamination", benchmark_stage), ("sentencepiece", token_stage)]

#: XXH64 fingerprints and subword merges are beyond SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
