"""A training corpus from raw documents: quality rules, near copies, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Stages are pure plans over their docs, so each can be written
and read back between stages, or composed as run() does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import jaccard, mixing, packing, quality, secrets
from trackloom.llm.common import Scratch, table
from trackloom.llm.queries import tokenizer_path

#: Domains and their shares of all tokens; the clean domain keeps what it has, and nothing is repeated.
MIX = mixing.MixConfig(targets={"clean": 0.99, "junk": 0.01, "toxic": 0.0}, most=1.0)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail them."""
    return quality.clean(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the five-word Jaccard join at 0.8."""
    return jaccard.drop_near_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced in their texts."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, its fractional part by a draw on their hash."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), MIX)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: The mixing rates are a numerical fit and the packing an optimisation, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written before the next one reads it."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
