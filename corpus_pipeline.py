"""A corpus pipeline from raw documents to packed training sequences.

Each stage works on all that the stage before it kept, and is written and read again before the next.
Near duplicates are taken at five-word shingles with 80 per cent in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import Work
from lexmill.llm.decontaminate import drop_contaminated
from lexmill.llm.language_id import keep_identified
from lexmill.llm.near_dup import drop_near_duplicates
from lexmill.llm.packing import pack_documents
from lexmill.llm.substring_dedup import without_repeated_words


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what the models reject goes."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Of rows that repeat an id and its text, one."""
    return drop_near_duplicates(docs, shingle=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages: a document that loses words becomes its other words, joined by one space, any other stays as it is."""
    return without_repeated_words(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("language identification", language),
    ("near-duplicate removal", near_dedup),
    ("repeated passage removal", substrings),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the joins is within SQL's reach (language models, sketches, tokenizers): see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), str(k), scan=True)
    return docs
