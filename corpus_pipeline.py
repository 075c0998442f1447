"""The corpus pipeline: raw documents to encoded training text, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and
returns the columns of ``documents``; the last returns a digest row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docscore.llm import bpe, decontam, exact_dedup, simhash, toxicity
from docscore.llm.storage import Workspace


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model rejects go.

    Null and empty texts stay, repeated rows share their fate, an empty table or one
    without labels loses nothing; extra columns are kept.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null is the empty text.

    A null id is smaller than any other; of rows that share the largest id one stays.
    An empty table gives an empty one; extra columns are kept.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays.

    Texts without words, null among them, are one group. A null id is larger than any
    other; of rows that share the smallest id one stays. An empty table gives an empty
    one; extra columns are kept.
    """
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text contains a benchmark item, re-parameterised ones too, go.

    Texts decide, so rows with a null or shared id are judged one by one. Null and empty
    texts stay; an empty table or benchmark changes nothing; extra columns are kept.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row per document.

    Null and empty texts have no tokens; repeated rows stay repeated; an empty table
    gives no rows; extra columns are not read.
    """
    return bpe.round_trip(docs, bpe.default_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_encoding", encode),
]

# components and learned lexicons are beyond SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
