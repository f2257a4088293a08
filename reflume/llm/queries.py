"""The registered queries of this subpackage: one for each operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, conversations, fingerprint, idfile, jaccard, langid, licenses, mixing, piecebpe, secretscan, tokencount, variants
from .common import stage_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the package that holds them is the environment's."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = idfile.write(table(spark, sf_dir, "documents"), stage_path(spark, "ids"), tokenizer("word_bpe_49k.json"))
    return idfile.read(spark, shards)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_sentencepiece_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_document_fingerprints, op2_license_scans, op3_secret_scans, op4_token_counts, op5_mixing_to_target_weights, op6_language_id, op7_bpe_encoding_decoding, op8_ngram_jaccard_join, op9_token_id_output, op10_nearest_neighbours, op11_conversation_repair, op12_sentencepiece_encoding_decoding, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scans": licenses.oracle(), "op5_mixing_to_target_weights": mixing.oracle()}
