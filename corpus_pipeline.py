"""The corpus pipeline: quality, near-duplicates, mix, tokens.

Each stage takes all documents its predecessor kept. All but the last return the columns of the
documents. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm import bpe, compression, mixing, near_copies
from scour.llm.names import free_name
from scour.llm.queries import TOKENIZER, fit_quality, source_weights
from scour.sources.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier takes for bad."""
    into = free_name(docs.columns, "score")
    scored = compression.score(docs, fit_quality(spark, docs, sf_dir), into=into)
    return scored.where(F.col(into) >= 0.5).drop(into)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of five-word shingles.

    Candidates by SimHash, and by min-hashes for those of more differing bits; whole sets are compared.
    """
    return near_copies.one_of_each(docs, width=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as its source's target asks."""
    into = free_name(docs.columns, "mix")
    return mixing.repeat_rows(mixing.mix(docs, source_weights(docs), into=into), into)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens, packed ids and SHA-256 of the text they decode to."""
    encoded = bpe.transcode(
        docs.select("doc_id", "lang", "source", "text"),
        public_tokenizers.path(TOKENIZER),
    )
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", encode),
]

# SQL can't express the first, second and fourth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
