"""The operators and the pipeline as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.session import ship_package

from . import ball_kmeans as balls
from . import decontaminate as decontam
from . import exact_dedup as exact
from . import fill_in_middle as fim
from . import lang_id, lm_scoring, minhash, pii, secret_scan, suffix_dedup
from . import quality as quality_
from . import sentencepiece_codec as pieces
from . import token_counts as tokens
from .common import fold, scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with an empty cache, so that each run does the whole work."""
    return tokens.token_counts(_documents(spark, sf_dir), scratch_path(spark, "token-cache"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(_documents(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = lang_id.train_language(docs.where(fold("doc_id", 3) != 1))
    return lang_id.identify_language(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_texts(_documents(spark, sf_dir), train=fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_.train_quality(docs, quality_labels(spark, sf_dir))
    return quality_.score_quality(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode_digest(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(suffix_dedup.remove_repeats(_documents(spark, sf_dir)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(_documents(spark, sf_dir))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = balls.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return balls.cluster_digest(*balls.ball_kmeans(vectors, k=40, rounds=5))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(secret_scan.find_secrets(_documents(spark, sf_dir)))


_ALL = (op1_exact_dedup, op2_token_counts, op3_pii, op4_language_id, op5_minhash_near_dedup, op6_lm_scoring, op7_quality, op8_decontaminate, op9_sentencepiece, op10_suffix_array_dedup, op11_fill_in_middle, op12_ball_kmeans, op13_secret_scan)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op1_exact_dedup": exact.SQL, "op3_pii": pii.SQL, "op5_minhash_near_dedup": minhash.SQL, "op8_decontaminate": decontam.SQL, "op10_suffix_array_dedup": suffix_dedup.SQL, "op11_fill_in_middle": fim.SQL, "op12_ball_kmeans": balls.SQL}
