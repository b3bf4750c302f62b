"""Source divergence audit: per-language count vectors, group sums and a sparse evaluation of all source pairs.

Null text, lang and source count as ''. Terms are the matches of ``TERM`` after lower-casing A-Z. Per language:

The group sums, the kept sums, the groups and the valued entries are written to the shared folder once each and read by the later
steps, which also cuts their lineage.

1. *Document vectors.* Each document's exact sparse count vector, as ``CountVectorizer.transform`` would give it, enters
   as its entries: each distinct term once (for the document frequency) and each occurrence once (for the count).
2. *Vocabulary and group sums.* One aggregate over the entries gives the sum of the vectors of each (lang, source)
   group (Summarizer-style, but sparse) and, per term, how many of the group's documents hold it; the document
   frequency of a term in a language is the sum of the latter over its sources, so the texts are read once. The vocabulary
   keeps the terms in at least ``MIN_DF`` documents of the language, with no cap on its size (``vocabSize`` the
   largest integer). It stays a distributed table: ``CountVectorizer.fit`` would gather it on the driver.
3. *Smoothed values.* For a group or language with total ``N`` over the ``V`` kept terms, a term with ``count`` gets
   ``p = 1 + floor(10^9 (count + 2) / (N + 2V))``, in decimals; ``f(p, q) = floor((p - q)^2 / (p + q))``.
4. *Pairs, sparse.* The value of a pair of sources is the sum of ``f`` over all kept terms. Terms that both hold come
   from a join of the group sums on (lang, term), at most one row per source and term; terms that one holds come from
   the histogram of its counts (how many terms have each count) against the other's zero value; terms that neither
   holds are counted, not listed. So no term is visited for a pair that holds it in neither group.
5. *Terms.* A group's kept terms with ``p`` above the language's are ranked by ``f`` against it, ten per group, with a
   group limit before the shuffle.

Defined results: every occurring (lang, source) group gives its pair rows, a group without terms too (then all its
counts are 0); a language with no kept term gives values 0 for its pairs and no term rows; a language with one
source has no pair rows. Ranks count from 1 per (lang, source, part), value descending, then item ascending in UTF-8
byte order. Repeated rows count every time. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.llm.common import ascii_ranges, split_lower, stored

# Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = ascii_ranges((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
MIN_DF = 10
SCALE = 1_000_000_000
TOP_TERMS = 10

# Largest number of (lang, source) groups that is broadcast to the histogram join.
BROADCAST_GROUPS = 200_000

_BIG = "decimal(38,0)"


def _blank(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def document_vectors(docs: DataFrame) -> DataFrame:
    """lang, source, term, d, o: the entries of each document's count vector, without a per-row program.

    Every distinct term of a document gives one row with ``d`` 1 (it counts once towards the document frequency) and
    every occurrence one row with ``o`` 1 (its count). Summed per (lang, source, term), on the map side first, they
    are the documents' exact count vectors added up per group. Built from ``array_distinct``, ``array_repeat`` and
    ``arrays_zip`` only, which run compiled; per-element lambdas would be interpreted.
    """
    terms = split_lower(_blank(docs["text"]), _BETWEEN)
    rows = docs.select(_blank(docs["lang"]).alias("lang"), _blank(docs["source"]).alias("source"), terms.alias("t"))
    rows = rows.select("lang", "source", "t", F.array_distinct("t").alias("u"))

    def entries(column: str, d: int, o: int) -> Column:
        n = F.size(column)
        return F.arrays_zip(
            F.col(column).alias("term"), F.array_repeat(F.lit(d), n).alias("d"), F.array_repeat(F.lit(o), n).alias("o")
        )

    return rows.select("lang", "source", F.inline(F.concat(entries("u", 1, 0), entries("t", 0, 1))))


def _p(count: str, total: str, v: str) -> Column:
    """p of named columns, by integral division of decimals."""
    return F.expr(
        f"1 + (cast({SCALE} as {_BIG}) * cast({count} + 2 as {_BIG})) div cast({total} + 2 * {v} as {_BIG})"
    ).cast("long")


def _f(p: str, q: str) -> Column:
    """f of named columns; p and q are at most 10^9 + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})").cast("long")


def divergence(docs: DataFrame, groups_limit: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    vectors = document_vectors(docs)
    sums = vectors.groupBy("lang", "source", "term").agg(F.sum("d").alias("docs"), F.sum("o").alias("c"))
    sums = stored(sums, "divergence-sums")
    # Every document is in one group, so a term's document frequency in a language is the sum over its sources.
    vocab = sums.groupBy("lang", "term").agg(F.sum("docs").alias("df")).filter(F.col("df") >= MIN_DF)
    kept = stored(sums.join(vocab.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "c"), "divergence-kept")
    sizes = vocab.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select(_blank(docs["lang"]).alias("lang"), _blank(docs["source"]).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    groups = (
        groups.join(sizes, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    )
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "total", "v"))), "divergence-groups")
    if groups.count() <= groups_limit:
        groups = F.broadcast(groups)
    entries = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "c", "v", _p("c", "total", "v").alias("p"), "p0"
    )
    entries = stored(entries, "divergence-entries")
    return _pairs(entries, groups).unionByName(_terms(kept, entries))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select("lang", F.col("source").alias("g"), "v", F.col("total").alias("ng"), F.col("p0").alias("p0g"))
    h = groups.select("lang", F.col("source").alias("h"), F.col("total").alias("nh"), F.col("p0").alias("p0h"))
    pairs = g.join(h, "lang").filter(F.col("g") != F.col("h"))
    # Terms that both groups hold: the exact value less what the one-sided sums below add for them.
    a = entries.select("lang", "term", F.col("source").alias("g"), F.col("p").alias("pg"), F.col("p0").alias("p0g"))
    b = entries.select("lang", "term", F.col("source").alias("h"), F.col("p").alias("ph"), F.col("p0").alias("p0h"))
    both = (
        a.join(b, ["lang", "term"])
        .filter(F.col("g") != F.col("h"))
        .groupBy("lang", "g", "h")
        .agg(
            F.sum(_f("pg", "ph") - _f("pg", "p0h") - _f("p0g", "ph")).alias("shared"),
            F.count("*").alias("nboth"),
        )
    )
    # Terms that a group holds, against the other's zero value, by the histogram of its counts.
    hist = entries.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    sizes = entries.groupBy("lang", "source").agg(F.count("*").alias("held"))
    one = (
        hist.join(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q")), "lang")
        .filter(F.col("source") != F.col("other"))
        .groupBy("lang", "source", "other")
        .agg(F.sum(F.col("m") * _f("p", "q")).alias("alone"))
    )
    value = (
        pairs.join(both, ["lang", "g", "h"], "left")
        .join(one.select("lang", F.col("source").alias("g"), F.col("other").alias("h"), F.col("alone").alias("ag")), ["lang", "g", "h"], "left")
        .join(one.select("lang", F.col("source").alias("h"), F.col("other").alias("g"), F.col("alone").alias("ah")), ["lang", "g", "h"], "left")
        .join(sizes.select("lang", F.col("source").alias("g"), F.col("held").alias("sg")), ["lang", "g"], "left")
        .join(sizes.select("lang", F.col("source").alias("h"), F.col("held").alias("sh")), ["lang", "h"], "left")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = F.col("v") - z("sg") - z("sh") + z("nboth")
    total = z("shared") + z("ag") + z("ah") + rest * F.coalesce(_f("p0g", "p0h"), F.lit(0))
    out = value.select(
        "lang",
        F.col("g").alias("source"),
        F.lit("pair").alias("part"),
        F.col("h").alias("item"),
        F.when(F.col("v") > 0, total).otherwise(F.lit(0)).cast("long").alias("value"),
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return out.withColumn("rank", F.row_number().over(order).cast("int"))


def _terms(kept: DataFrame, entries: DataFrame) -> DataFrame:
    whole = kept.groupBy("lang", "term").agg(F.sum("c").alias("c"))
    whole = whole.join(whole.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("v")), "lang")
    whole = whole.select("lang", "term", _p("c", "n", "v").alias("q"))
    above = entries.join(whole, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    out = above.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return out.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= TOP_TERMS)
