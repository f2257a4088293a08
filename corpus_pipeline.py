"""A training corpus in five stages, each an operator of ``reflume.llm`` over all that the stage before kept.

language_id drops documents in no learned language, and none where no row has a label; near_duplicates keeps the document
with the smallest doc_id of each group; secrets masks credentials that aren't widely copied
examples; mixing cuts sources with over a third of the documents down to a third of what is
kept, keeps all others whole, and writes them in the order of the mixture's schedule; encoding gives the token ids' and the decoded text's
digests, and each document's place in the schedule of what is kept. Stages pass on the columns of documents; each is written as Parquet and read again.

Null and wordless texts are in no language, so they go where labels exist; else they stay, as near_duplicates keeps all documents without
words or without doc_id. Of repeated ids in a group one row stays, as ``jaccard.representatives`` says; ids with texts in several groups have a row in each. A null source is
the empty name, null ids come first in a source, and places are distinct whatever is repeated. Empty tables stay empty. Other columns, whatever their names,
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reflume.llm import bpe, jaccard, langid, mixing, secretscan
from reflume.llm.common import materialize
from reflume.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.without_surplus(docs, block_rows=1, period=10_000)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = materialize(bpe.digests(docs, tokenizer("byte_bpe_50k.json"), kept=("source",)), "encoded")
    placed = mixing.mix(made.withColumn("text", F.col("decoded_sha256")), block_rows=1, period=10_000)
    return placed.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "place")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix),
    ("encoding", encoding),
]

#: Automata, sketches and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
