"""From raw documents to packed training sequences: language, quality, near duplicates, secrets, packing.

Each stage takes all that its predecessor kept, as a written table with the columns of documents, and all but the last
return those columns. The last returns the pieces of every document and their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language, near_text, packing, quality, secrets
from quarry.llm.common import table, written
from quarry.session import ship


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; texts without letters, or unlike all languages, go."""
    ship(spark)
    return language.recognised(docs, "doc_id", "text", "lang")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, and the soft ones where their source is a bad host."""
    ship(spark)
    return quality.passed(docs, "doc_id", "text", "source")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash links, then all other pairs of five-word shingles with a resemblance of 0.8 or more."""
    ship(spark)
    return near_text.one_of_each(docs, "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their findings redacted but for widely copied examples, and n_chars as it is then."""
    ship(spark)
    out = secrets.redacted(docs, "text", "source", "doc_id")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces of at most 2048 tokens and their places in sequences."""
    ship(spark)
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", languages),
    ("quality rules", good),
    ("near duplicates", distinct),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Suffix automata, hashes and tokenizers have no SQL; tests/llm holds each stage and the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
