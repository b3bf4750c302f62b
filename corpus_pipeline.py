"""From raw documents to packed training sequences.

Every stage gets the documents its predecessor kept, written as Parquet and read again, and its decision takes effect:
undetermined languages go, of equal texts one row stays, of each class of near copies one row stays, secrets are
masked in the text, and what is left is packed. All stages but the last return the columns of ``documents``. Null and
empty texts have no language and go in the first stage; the other rules for nulls, ties and repeated rows are those
of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabaudit.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from tabaudit.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# SQL can express neither the language model nor the sketches nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
