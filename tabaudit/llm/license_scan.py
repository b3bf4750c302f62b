"""License scan by diagonal voting.

A text is lower-cased (A-Z only) and read as words of digits, letters and everything beyond ASCII. Two kinds of
templates are looked for: base phrases, which must stand word for word, and longer notices, which may be edited.

Every rolling word k-gram of the texts is joined to the places of the templates' k-grams. A match at text place p and
template place t votes for the diagonal p - t. Votes are counted per document, template and diagonal; neighbouring
diagonals whose matches follow each other are merged, so that a word left out or put in does not break a notice.
A merged span is verified: matches must cover ``COVERED`` of the template's words and ``DENSE`` of the span's.

The templates are a fixed table of a few hundred rows; that side of the join is broadcast. K-grams that are in no
template never leave the task that reads the text: the set of template hashes is tested there before the join.

A null text counts as empty. ``doc_id`` may be null or repeated: every row has its own result. An empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabaudit.llm.common import code_points, hashes_of_points, numbered, rolling, stored, whole_text

# Phrases that must stand as they are, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Short notices as they are commonly written, with a label for the exact license.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
        "apache-2.0",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "mit",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
)
GRAM = 3
SLACK = 4
COVERED = 0.8
DENSE = 0.7


def _word_points() -> np.ndarray:
    inside = np.ones(0x110000, bool)
    inside[0x00:0x30] = inside[0x3A:0x61] = inside[0x7B:0x80] = False
    return inside


def license_words(text: str, inside: np.ndarray) -> np.ndarray:
    """The hash of every word, with A-Z read as a-z."""
    points = code_points(text)
    points = np.where((points >= 0x41) & (points <= 0x5A), points + 32, points)
    return hashes_of_points(points, inside)


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def templates() -> list[tuple[int, int, int, str, int, int, bool]]:
    """size, hash, template, label, place, words and whether it is a base phrase, of every k-gram."""
    inside, rows = _word_points(), []
    for number, (text, label) in enumerate([*PHRASES, *NOTICES]):
        words, base = license_words(text, inside), number < len(PHRASES)
        size = len(words) if base else GRAM
        for place, h in enumerate(_signed(rolling(words, size))):
            rows.append((size, h, number, label, place, len(words), base))
    return rows


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words and the k-grams (size, place, hash) that some template has, of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"))
    wanted: dict[int, list[int]] = {}
    for size, h, *_ in templates():
        wanted.setdefault(size, []).append(h)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = _word_points()
        sets = {size: np.array(sorted(set(hashes)), np.int64) for size, hashes in wanted.items()}
        hit = pa.struct([("size", pa.int32()), ("place", pa.int64()), ("hash", pa.int64())])
        for first, batch in numbered(batches):
            counts, hits = [], []
            for text in batch.column("text").to_pylist():
                words = license_words(text, inside)
                found = []
                for size, known in sets.items():
                    grams = rolling(words, size).view(np.int64)
                    places = np.flatnonzero(known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams)
                    found += [
                        {"size": size, "place": p, "hash": h}
                        for p, h in zip(places.tolist(), grams[places].tolist(), strict=True)
                    ]
                counts.append(len(words))
                hits.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first, first + batch.num_rows), pa.int64()),
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(hit)),
                ],
                ["row", "doc_id", "n_words", "hits"],
            )

    return texts.mapInArrow(
        scan, f"row long, doc_id {kind}, n_words long, hits array<struct<size:int,place:long,hash:long>>"
    )


def template_table(spark: SparkSession) -> DataFrame:
    schema = "size int, hash long, template int, label string, at long, words long, base boolean"
    return F.broadcast(spark.createDataFrame(templates(), schema))


def spans(votes: DataFrame) -> DataFrame:
    """Merged diagonals: row, template, label, start, stop, covered and dense of every span of a notice."""
    diagonals = votes.groupBy("row", "template", "label", "words", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.array_sort(F.collect_set("at")).alias("ats")
    )
    order = W.partitionBy("row", "template").orderBy("first", "diagonal")
    before = F.lag("diagonal").over(order)
    ended = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.abs(F.col("diagonal") - before) > SLACK) | (F.col("first") - ended > GRAM + SLACK)
    marked = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    marked = marked.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy("row", "template", "label", "words", "span").agg(
        F.min("first").alias("start"),
        (F.max("last") + GRAM).alias("stop"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
    )
    # The template's words under the matching k-grams.
    under = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1)))))
    return merged.select(
        "row",
        "template",
        "label",
        "start",
        "stop",
        (under / F.col("words")).alias("covered"),
        F.least(F.lit(1.0), under / (F.col("stop") - F.col("start"))).alias("dense"),
    )


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    scanned = stored(matches(docs), "license-matches")
    votes = scanned.select("row", F.inline("hits")).join(template_table(docs.sparkSession), ["size", "hash"])
    votes = stored(votes.select("row", "place", "template", "label", "at", "words", "base"), "license-votes")
    base = votes.filter("base").groupBy("row").agg(
        F.count("*").alias("n_base"),
        F.min("place").alias("first_word"),
        F.max("place").alias("last_word"),
        F.collect_set("label").alias("base_found"),
    )
    found = spans(votes.filter("NOT base"))
    sure = (F.col("covered") >= COVERED) & (F.col("dense") >= DENSE)
    notices = found.groupBy("row").agg(
        F.collect_set(F.when(sure, F.col("label"))).alias("notices"), F.max(F.col("covered") * F.col("dense")).alias("best")
    )
    rows = scanned.select("row", "doc_id", "n_words").join(base, "row", "left").join(notices, "row", "left")
    none = F.expr("CAST(array() AS array<string>)")
    own = F.coalesce("base_found", none)
    every = F.array_distinct(F.concat(own, F.coalesce("notices", none)))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
