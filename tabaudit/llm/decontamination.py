"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Texts are lower-cased in A-Z and cut into words (runs of characters outside the ASCII punctuation, digits excepted).
An item of ``benchmark`` gives its windows: every run of ``WINDOW`` consecutive words, or the whole item when it has
fewer words (but some). A document word is *hit* when it lies inside any occurrence of any window.

The join, in the order of the method:

1. *Rarity.* Every word of the corpus is counted once (a partial aggregate, so a word in a third of all rows reaches
   the shuffle once per task). Each window orders its words by that count, then by the word itself.
2. *Necessary prefix.* A window can only occur where its rarest word occurs: for exact containment the prefix is one
   token. The window keeps that word and its offset in the window.
3. *Join.* Every document word is joined with the windows whose prefix it is. When the windows are measured to hold
   less than ``BROADCAST_BYTES``, they are broadcast and the documents are not shuffled at all (the word counts of
   step 1 are then also limited to benchmark words before their aggregate). Otherwise the join is on (word, salt):
   the document side takes one of ``SALTS`` salts by its place, the window side is repeated in all of them, so a hot
   prefix word is split in ``SALTS`` tasks.
4. *Bounds.* Its offset places a candidate: it starts ``offset`` words earlier. Starts before the document or windows
   that would run past its last word are dropped (positional and length bounds).
5. *Verification.* The candidates, grouped per document, are written to the shared folder; below
   ``BROADCAST_BYTES`` they are broadcast to the documents, else both sides are shuffled on ``doc_id``. In the row
   of its document each candidate is compared word by word with the document's words over the window's whole size.

Defined results: a null text or a text without words has no words, no hits and no items; items with a null text or no
words have no windows; benchmark rows with a null ``item_id`` are not items; repeated items, windows and rows are
counted once where they coincide. Every input row gives one output row, rows with a repeated or null ``doc_id`` too
(their candidates are pooled, and each row keeps those that its own words confirm). An empty table gives an empty
result; other columns of either table are not looked at, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import ascii_ranges, split_lower, stored, whole_text

# Fixed values of the contract: the word pattern and the size of a window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# The characters between words: the complement of WORD's class within ASCII.
_BETWEEN = ascii_ranges((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

# Salts of the candidate join: a prefix word held by a third of all words is split in this many tasks.
SALTS = 16
# Largest side that is broadcast, measured before the join (Spark's own estimate of a word array is far too low).
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z; a null text has none."""
    return split_lower(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and win (array of words) of every distinct window of every item."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id"), words_of(benchmark["text"]).alias("w")
    )
    items = items.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    win = F.transform(starts, lambda i: F.slice("w", i + 1, F.least(F.size("w"), F.lit(size))))
    return items.select("item_id", F.explode(win).alias("win")).distinct()


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, n (words of the row), pos and word of every word of every document."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), words_of(docs["text"]).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))


def _prefixes(wins: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """Each window with its rarest word and that word's offset, repeated in every salt."""
    spread = wins.select("item_id", "win", F.posexplode("win").alias("off", "word"))
    ranked = spread.join(counts, "word", "left").select(
        "item_id", "win", F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "word", "off").alias("key")
    )
    best = ranked.groupBy("item_id", "win").agg(F.min("key").alias("key"))
    return best.select(
        "item_id",
        "win",
        F.col("key.word").alias("word"),
        F.col("key.off").alias("off"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )


def _bytes(words: int, rows: int) -> int:
    return 24 * words + 64 * rows


def candidates(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, salts: int = SALTS, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """doc_id and the list of (start, len, item_id, win) that the prefix join and the bounds leave."""
    occ = _occurrences(docs)
    wins = windows(benchmark, size)
    measured = wins.agg(F.count("*").alias("rows"), F.sum(F.size("win")).alias("words")).first()
    if _bytes(measured["words"] or 0, measured["rows"]) <= limit:
        vocabulary = wins.select(F.explode("win").alias("word")).distinct()
        counts = occ.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("freq"))
        pre = F.broadcast(_prefixes(wins, counts, 1).drop("salt"))
        hits = occ.join(pre, "word")
    else:
        counts = occ.groupBy("word").agg(F.count("*").alias("freq"))
        pre = _prefixes(wins, counts, salts)
        salted = occ.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(salts)).cast("int"))
        hits = salted.join(pre, ["word", "salt"])
    hits = hits.select(
        "doc_id", (F.col("pos") - F.col("off")).alias("start"), F.size("win").alias("len"), "item_id", "win", "n"
    )
    bounded = hits.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    return bounded.groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "len", "item_id", "win")).alias("cands")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, salts: int = SALTS, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``."""
    found = stored(candidates(docs, benchmark, size, salts, limit), "decontamination-candidates")
    measured = found.agg(F.count("*").alias("rows"), F.sum(F.aggregate("cands", F.lit(0), lambda n, c: n + c["len"])).alias("words")).first()
    found = found.withColumnRenamed("doc_id", "cand_id")
    if _bytes(measured["words"] or 0, measured["rows"]) <= limit:
        found = F.broadcast(found)
    rows = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("body"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("cand_id")), "left")
    w = words_of(F.col("body"))
    sure = F.filter(
        F.coalesce(F.col("cands"), F.array().cast(found.schema["cands"].dataType)),
        lambda c: F.slice(F.col("w"), c["start"] + 1, c["len"]) == c["win"],
    )
    staged = joined.select("doc_id", w.alias("w"), "cands").select("doc_id", "w", sure.alias("sure"))
    covered = F.array_distinct(F.flatten(F.transform("sure", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    items = F.array_sort(F.array_distinct(F.transform("sure", lambda c: c["item_id"].cast("string"))))
    out = staged.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"),
        items.alias("items"),
    )
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
