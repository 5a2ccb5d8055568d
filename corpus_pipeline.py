"""The corpus pipeline: from documents to encoded training texts.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of documents.

1. quality classifier: rows that the compression classifier predicts as bad go.
   It learns from labels whose crc32(doc_id as text) mod 5 is not 0.
2. exact dedup: of equal texts the one with the largest doc_id stays.
3. MinHash near-dedup: of documents linked by shingles of five words and a
   similarity of 0.8 or more the one with the smallest doc_id stays.
4. benchmark decontamination: documents that hold a passage of benchmark go.
5. SentencePiece encoding and decoding: number and digest of ids, and digest of
   the decoded text, for each document left.

Null texts count as empty, rows without an id are never duplicates of others by
near-dedup nor contaminated, and an empty table gives no rows. Very long texts are
taken whole; columns beside doc_id and text may have any names and pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenflow.llm import decontaminate, exact_dedup, minhash, quality, queries, sentencepiece_codec
from lumenflow.llm.common import remove_scratch, scratch_tables, stored
from lumenflow.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Each row is judged by its text alone, so repeated rows and ties fare alike; null and empty texts have a score too."""
    ship_package(spark)
    return quality.quality_filter(docs, quality.train_quality(docs, queries.quality_labels(spark, sf_dir)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: of equal ones that with the largest doc_id, null ids last; of rows equal in both any one. Null and empty texts are one group."""
    return exact_dedup.exact_dedup_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents those with the smallest doc_id; repeated rows of that document all stay, and so do rows without an id or without words."""
    ship_package(spark)
    return minhash.near_duplicate_filter(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of benchmark. Repeated rows and rows that repeat an id go or stay together; null and empty texts and rows without an id stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row left, in whatever order: null and empty texts have the end id alone, repeated rows equal results."""
    ship_package(spark)
    return sentencepiece_codec.encode_decode_digest(docs, queries.vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
#: A fitted classifier and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's scratch tables, and the table before it, go once its own is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        older = scratch_tables()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
            made = [path for path in scratch_tables() if path not in older]
            remove_scratch(spark, before + made[:-1])
            before = made[-1:]
    return docs
