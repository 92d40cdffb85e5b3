"""The queries of this package, as the driver runs them: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import digest, hardneg, htmltext, langid, mixing, nbsvm, neardup, packing, quality, secretscan, sharding, tokenfile, whitening
from .common import read_documents
from .oracles import ORACLE_SQL as ORACLE_SQL


def op1_tree_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_output(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read_documents(spark, sf_dir), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_documents(spark, sf_dir), shards=8)


def op5_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op6_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(read_documents(spark, sf_dir))


def op7_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_identification(read_documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir), max_epochs=2.0, entropy_gain=0.5)


def op10_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(read_documents(spark, sf_dir))


def op11_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.held_out_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_tree_model_text": op1_tree_model_text,
    "op2_token_output": op2_token_output,
    "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_line_frequency_quality": op5_line_frequency_quality,
    "op6_trigram_secret_scan": op6_trigram_secret_scan,
    "op7_centroid_language": op7_centroid_language,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_quartile_digest": op10_quartile_digest,
    "op11_nb_svm_quality": op11_nb_svm_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_whitening": op13_embedding_whitening,
}
