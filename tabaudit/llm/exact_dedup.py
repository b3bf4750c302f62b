"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; the row with the largest ``doc_id`` stays. Every
stage groups on the digest *and* the whole text, so content is compared in full:

1. tasks combine the equal texts they hold (the map side of the first grouping);
2. groups of (digest, salt, text) merge what the tasks found: a text that fills a third of all rows arrives as one
   row per task, dealt over ``SALTS`` groups;
3. the winners of all salts are combined per (digest, text).

A null text counts as empty. A null ``doc_id`` is smaller than any other and equal to itself. Rows that repeat both
``doc_id`` and text are one document: ``exact_groups`` returns them once (``group_size`` counts every row), and
``drop_exact_copies`` keeps one of them. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import ascii_lower, stored, whole_text

SALTS = 16


def _texts(docs: DataFrame) -> DataFrame:
    text = ascii_lower(whole_text(docs))
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        text.alias("body"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
    )


def _winners(texts: DataFrame, salts: int) -> DataFrame:
    """One row per different text: digest, body, the doc_id that stays and the rows."""
    salted = texts.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "body").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("n")
    )
    return salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def _members(texts: DataFrame, key: list[str], winners: DataFrame) -> DataFrame:
    documents = texts.groupBy("doc_id", *key).agg(F.count("*").alias("times"))
    return documents.join(winners, key).select("doc_id", "digest", "keep_id", "n", "times")


def _assigned(docs: DataFrame, salts: int) -> DataFrame:
    texts = _texts(docs)
    # The texts are not written with the winners: a digest stands for its text unless two texts share it.
    winners = stored(_winners(texts, salts).select("digest", "keep_id", "n"), "exact-winners")
    shared = winners.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    if shared.isEmpty():
        return _members(texts, ["digest"], winners)
    clashing = texts.join(shared, "digest", "left_semi")
    return _members(texts.join(shared, "digest", "left_anti"), ["digest"], winners).unionByName(
        _members(clashing, ["digest", "body"], _winners(clashing, salts))
    )


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    return _assigned(docs, salts).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = _assigned(docs, salts).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = stored(stay.select("doc_id", "digest", "times"), "exact-stay")
    body = ascii_lower(whole_text(docs))

    def rows(keys: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.sha2(body.cast("binary"), 256) == keys["digest"])
        return docs.join(keys, same, "left_semi")

    kept = rows(stay.filter("times = 1"))
    repeated = stay.filter("times > 1")
    if repeated.isEmpty():
        return kept
    once = rows(repeated)
    names = once.columns
    once = once.withColumn("__body", ascii_lower(whole_text(once))).dropDuplicates(["doc_id", "__body"])
    return kept.unionByName(once.select(names))
