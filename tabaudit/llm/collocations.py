"""Phrase collocation mining by a multikey three-way quicksort of suffix pointers.

Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces and
tabs. Every word occurrence starts a suffix of its piece; the first ``DEPTH`` words of a suffix are all a phrase of up
to ``DEPTH`` words needs. Per language (null: ``und``):

1. *Frequent hashes.* Tasks read texts in slices of Arrow buffers and count 64-bit hashes of (language, word) and of
   (language, word, next word), cut to 44 bits; then, where both pairs are frequent, of three words. Each slice sends
   its hashes sorted and packed by their first bits (``BLOCK_BITS``), four bytes each and a count of at most
   ``MIN_COUNT``; one group per block adds them up.
   A phrase that occurs ``MIN_COUNT`` times has all its words, pairs and triples as frequent, so:
2. *Suffix pointers.* Every word occurrence starts a head: the first four words of its suffix, cut before the first
   word whose pair or triple with those before it is not frequent (null past the cut or the end of the piece; all null
   if the first word is not frequent).
   Equal heads are combined with a count, first in each slice, then in each task, then globally, so a passage that
   fills a third of the corpus becomes one row with a large count: no key is hot after this step. Words are compared
   as such, never by hash. Frequent hashes are marked in a bitmap of ``FILTER_BITS`` that every task gets; beyond
   ``BROADCAST_ROWS`` words and pairs, pairs are joined by shuffle instead, without triples. A hash or bit shared by
   two phrases only makes heads longer, so no count is lost.
3. *Global routing by leading words.* The combined suffixes are range-partitioned by (lang, w1, w2, w3, w4): each task
   holds one contiguous range of the sorted suffixes.
4. *Multikey three-way quicksort* (Bentley and Sedgewick) in each task, on all its segments at once with numpy: a
   segment is split around a pivot into smaller, equal and larger at its depth; the equal part moves one word deeper.
   The size of an equal part (the sum of its counts) is the count of the phrase it fixes; that of a language, without
   words, is its number of words. An equal part smaller than
   ``MIN_COUNT`` is abandoned unless its phrase may go on in the next task (only the phrases of a task's least and
   greatest suffix can); those partial counts are summed over the tasks afterwards.
5. Candidates (2 to 4 words, count at least ``MIN_COUNT``) are scored by their weakest cut, compared exactly in
   decimals, thinned by the containment rule and ranked per language with a group limit before the shuffle.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count every time; a
language with no candidate gives no row; an empty table gives an empty result. Ties in score and count are ordered by
the phrase in UTF-8 byte order. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabaudit.llm.common import handing_back, mixed, stored, whole_text

# Fixed values of the contract.
PIECE = r"[.,;:!?\x0A-\x0D]"
WORD = r"[^\x20\x09]+"
DEPTH = 4
MIN_COUNT = 30
SCALE = 2_000_000
KEEP_PERCENT = 80
TOP = 2000

_SORTED = "lang string, phrase string, len int, f long, edge boolean"

# Bytes of text that a task cuts into words at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

# Hashes are cut to HASH_BITS: the first BLOCK_BITS name the group that adds up their counts, the others fill four
# bytes.
BLOCK_BITS = 12
HASH_BITS = BLOCK_BITS + 32
_KEPT = np.uint64((1 << 64) - (1 << (64 - HASH_BITS)))

# Bits of the filter with the frequent hashes that every task gets (32 MB), by the first bits of a hash. Up to
# BROADCAST_ROWS frequent words and pairs set one bit in four at most; beyond, the pairs are joined by shuffle.
FILTER_BITS = 28
BROADCAST_ROWS = 1 << (FILTER_BITS - 2)

_WORDS = [f"w{k + 1}" for k in range(DEPTH)]
_HEADS = "lang string, " + ", ".join(f"{w} string" for w in _WORDS)

# UTF-8 bytes, which hold ASCII characters only as themselves: lower case of A-Z, ends of pieces, parts of words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_INSIDE = ~_ENDS
_INSIDE[list(b"\x20\x09")] = False
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _texts(docs: DataFrame) -> DataFrame:
    """lang and text of every document; a line feed ends the last piece of each text."""
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.concat(whole_text(docs), F.lit("\n")).alias("text"))


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string; none is empty."""
    at = np.frombuffer(strings.buffers()[1], np.int32).astype(np.int64)
    at = at[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    powers = np.multiply.accumulate(np.full(size.max(), _ODD, np.uint64))
    place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], size)
    return mixed(np.add.reduceat(_VALUES[data] * powers[place], at[:-1] - at[0]) + size.astype(np.uint64))


class _Slice:
    """The words of some texts: ``words`` (distinct), ``code`` of each occurrence, ``same`` where the next one is in its
    piece, ``lang`` (codes of ``langs``), and the hashes ``single`` and ``pair`` (only of use where ``same``)."""

    def __init__(self, lang: pa.Array, data: np.ndarray, ends: np.ndarray):
        data = _LOWER[data]
        inside = _INSIDE[data]
        # Every text ends outside words, so words begin and end where ``inside`` changes.
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate([[0], change])
        first, size = change[::2], change[1::2] - change[::2]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        each = pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(data[inside])).dictionary_encode()
        self.words, self.code = each.dictionary, each.indices.to_numpy()
        piece = np.searchsorted(np.flatnonzero(_ENDS[data]), first)
        self.same = np.zeros(len(first), bool)
        self.same[:-1] = piece[1:] == piece[:-1]
        lang = lang.dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy().astype(np.int64)[np.searchsorted(ends, first, side="right")]
        if len(first):
            names = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in self.langs.to_pylist()]
            own = np.frombuffer(b"".join(names), np.uint64)[self.lang]
            plain = _hashes(self.words)[self.code]
            self.single = mixed(plain + own) & _KEPT
            self.pair = mixed(self.single * _ODD + np.roll(plain, -1)) & _KEPT

    def triples(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the pair is marked, where the next pair of the piece is too, and the hashes of three words there."""
        pairs = np.flatnonzero(self.same)
        pairs = pairs[_marked(marks, self.pair[pairs])]
        go = np.zeros(len(self.code) + 1, bool)
        go[pairs] = True
        both = pairs[go[pairs + 1]]
        return go[:-1], both, mixed(mixed(self.pair[both]) * _ODD + self.pair[both + 1]) & _KEPT


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    """The words of the texts (lang, text), some MB at a time; slices without words are left out."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lang, text = batch.column("lang").cast(pa.string()), batch.column("text").cast(pa.large_string())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
            found = _Slice(lang[lo:hi], data[at[lo] : at[hi]], at[lo + 1 : hi + 1] - at[lo])
            if len(found.code):
                yield found
            lo = hi


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut at ``ends``."""
    at = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, pa.py_buffer(values)])


def _packed(hashes: np.ndarray) -> pa.RecordBatch:
    """The distinct hashes by blocks, with their counts; only whether a count reaches ``MIN_COUNT`` matters later."""
    h, c = np.unique(hashes, return_counts=True)
    block, first = np.unique(h >> np.uint64(64 - BLOCK_BITS), return_index=True)
    ends = np.append(first, len(h))
    low = (h >> np.uint64(64 - HASH_BITS)).astype(np.uint32)
    counts = np.minimum(c, MIN_COUNT).astype(np.uint8)
    columns = [pa.array(block.astype(np.int32)), _binary(low, ends), _binary(counts, ends)]
    return pa.RecordBatch.from_arrays(columns, ["block", "low", "c"])


def _frequent(texts: DataFrame, hashes: Callable[[_Slice], np.ndarray], name: str) -> DataFrame:
    """h: those of the ``hashes`` of all slices that occur ``MIN_COUNT`` times or more.

    A hash that two phrases share only counts more, so every frequent one is among them.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            yield _packed(hashes(s))

    def add(block: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(block.column("low").to_pylist()), np.uint32)
        c = np.frombuffer(b"".join(block.column("c").to_pylist()), np.uint8)
        found, at = np.unique(low, return_inverse=True)
        found = found[np.bincount(at, c) >= MIN_COUNT].astype(np.uint64) << np.uint64(64 - HASH_BITS)
        found |= np.uint64(block.column("block")[0].as_py() << (64 - BLOCK_BITS))
        return pa.table({"h": found.view(np.int64)})

    blocks = texts.mapInArrow(handing_back(pack), "block int, low binary, c binary").groupBy("block")
    return stored(blocks.applyInArrow(add, "h long"), f"collocation-{name}")


def frequent_hashes(texts: DataFrame) -> DataFrame:
    """h: the hashes of words and pairs that occur ``MIN_COUNT`` times or more."""
    return _frequent(texts, lambda s: np.concatenate([s.single, s.pair[s.same]]), "pairs")


def frequent_triples(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """h: the hashes of three words that occur ``MIN_COUNT`` times or more, among those whose pairs are marked."""
    return _frequent(texts, lambda s: s.triples(marks)[2], "triples")


def _filter(frequent: DataFrame) -> np.ndarray:
    """The bits of the frequent hashes, gathered in blocks of Spark's bitmaps."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    block, place = F.shiftright(bit, 15), bit.bitwiseAND(F.lit((1 << 15) - 1))
    blocks = frequent.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))
    marks = np.zeros((1 << (FILTER_BITS - 15), 1 << 12), np.uint8)
    for row in blocks.collect():
        marks[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return marks.ravel()


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _lengths(s: _Slice, marks: np.ndarray) -> np.ndarray:
    """The length of the head at each place: it goes on while its words, pairs and triples are marked."""
    two, both, h = s.triples(marks)
    three = np.zeros(len(two) + 1, bool)
    three[both] = _marked(marks, h)
    out = _marked(marks, s.single).astype(np.int64)
    for longer in (two, three[:-1], three[:-1] & three[1:]):
        out += longer & (out > 0)
    return out


def _heads(s: _Slice, length: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The distinct heads of ``length`` words from every place: columns lang and w1 .., counts, and a place of each."""
    wide = len(s.words) + 1
    code = np.concatenate([s.code.astype(np.int64) + 1, np.zeros(DEPTH, np.int64)])
    w = [np.where(length > k, code[k : k + len(length)], 0) for k in range(DEPTH)]
    # Two numbers hold a head: in SLICE_BYTES, languages times the square of distinct words stay below 2**63, and a
    # longer slice is one text.
    start, rest = (s.lang * wide + w[0]) * wide + w[1], w[2] * wide + w[3]
    table = pa.table({"start": start, "rest": rest, "at": np.arange(len(start))})
    table = table.group_by(["start", "rest"], use_threads=False).aggregate([("at", "min"), ("at", "count")])
    at = table.column("at_min").to_numpy()
    columns = [s.langs.take(pa.array(s.lang[at]))]
    columns += [s.words.take(pa.array(x[at] - 1, mask=x[at] == 0)) for x in w]
    return columns, table.column("at_count").to_numpy(), at


def suffixes(texts: DataFrame, frequent: DataFrame, limit_rows: int = BROADCAST_ROWS) -> DataFrame:
    """lang, w1 .. w4 and c: distinct suffix heads, cut before the first pair or triple that is not frequent, with the
    number of word occurrences that start them; a first word that is not frequent may be null."""
    if frequent.count() <= limit_rows:
        marks = _filter(frequent)
        marks |= _filter(frequent_triples(texts, marks))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _slices(batches):
                columns, c, _ = _heads(s, _lengths(s, marks))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(c)], ["lang", *_WORDS, "c"])

        rows = texts.mapInArrow(handing_back(cut), f"{_HEADS}, c long")
    else:
        # Whole heads with the hashes of their pairs; the first word stays.
        pairs = [f"h{k}" for k in range(1, DEPTH)]

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _slices(batches):
                same = np.concatenate([s.same, np.zeros(DEPTH, bool)])
                go = np.cumprod([same[k : k + len(s.same)] for k in range(DEPTH - 1)], axis=0)
                columns, c, at = _heads(s, 1 + go.sum(axis=0))
                # A pair past the end of the piece has some hash, but its word is null anyway.
                pair = np.concatenate([s.pair, np.zeros(DEPTH, np.uint64)]).view(np.int64)
                own = [pa.array(pair[at + k]) for k in range(DEPTH - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *own, pa.array(c)], ["lang", *_WORDS, *pairs, "c"])

        schema = f"{_HEADS}, {', '.join(f'{h} long' for h in pairs)}, c long"
        rows, go, kept = texts.mapInArrow(handing_back(whole), schema), F.lit(True), [F.col(_WORDS[0])]
        for h, w in zip(pairs, _WORDS[1:], strict=True):
            rows = rows.join(frequent.select(F.col("h").alias(h), F.lit(True).alias(f"is_{h}")), h, "left")
            go = go & F.col(f"is_{h}").isNotNull()
            kept.append(F.when(go, F.col(w)).alias(w))
        rows = rows.select("lang", *kept, "c")
    return rows.groupBy("lang", *_WORDS).agg(F.sum("c").alias("c"))


def _codes(column: pa.Array) -> np.ndarray:
    """Dense ranks of the values in byte order, null as -1, so that comparing codes compares values."""
    if len(column) == 0:
        return np.zeros(0, np.int64)
    ranks = pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    codes = ranks.to_numpy(zero_copy_only=False).astype(np.int64) - 1
    if column.null_count:
        codes -= 1
        codes[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return codes


def _extreme(keys: np.ndarray, pick) -> np.ndarray:
    """The key of the least (``np.min``) or greatest (``np.max``) row, comparing column by column."""
    alive = np.arange(keys.shape[1])
    for d in range(keys.shape[0]):
        alive = alive[keys[d, alive] == pick(keys[d, alive])]
    return keys[:, alive[0]]


def three_way_counts(keys: np.ndarray, weights: np.ndarray, least: int, depth: int = DEPTH, shallowest: int = 1):
    """Multikey three-way quicksort of rows of ``keys`` (row 0: language, rows 1..: words, -1 past the end).

    Returns element, length, count and edge of every equal part at word depth ``shallowest``..``depth`` that is kept:
    count at least ``least``, or ``edge``: its prefix is that of the least or greatest row, so other tasks may hold
    more. Shallower parts are sorted on without a count.
    """
    n = keys.shape[1]
    found = ([], [], [], [])
    if n == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, bool),)
    low, high = _extreme(keys, np.min), _extreme(keys, np.max)
    order = np.arange(n)
    lo, hi = np.array([0]), np.array([n])
    at, pmin, pmax = np.array([0]), np.array([True]), np.array([True])
    while len(lo):
        size = hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        first = np.cumsum(size) - size
        pos = lo[seg] + np.arange(len(seg)) - first[seg]
        pivot = keys[at, order[(lo + hi) // 2]]
        cls = np.sign(keys[at[seg], order[pos]] - pivot[seg]) + 1
        group = seg * 3 + cls
        perm = np.argsort(group, kind="stable")
        moved = order[pos][perm]
        order[pos] = moved
        counts = np.bincount(group, minlength=3 * len(lo)).reshape(-1, 3)
        sums = np.concatenate([[0], np.cumsum(weights[moved])])
        ends = np.cumsum(counts.ravel()).reshape(-1, 3)
        eq_lo, eq_hi = lo + counts[:, 0], lo + counts[:, 0] + counts[:, 1]
        eq_w = sums[ends[:, 1]] - sums[ends[:, 0]]
        eq_min = pmin & (pivot == low[at])
        eq_max = pmax & (pivot == high[at])
        edge = eq_min | eq_max
        word = (at >= shallowest) & (pivot >= 0)
        keep = word & ((eq_w >= least) | edge)
        found[0].append(order[eq_lo[keep]])
        found[1].append(at[keep])
        found[2].append(eq_w[keep])
        found[3].append(edge[keep])
        deeper = (at < shallowest) | (keep & (at < depth))
        parts = [
            (lo, eq_lo, at, pmin, pmax, counts[:, 0] > 0),
            (eq_lo, eq_hi, at + 1, eq_min, eq_max, deeper),
            (eq_hi, hi, at, pmin, pmax, counts[:, 2] > 0),
        ]
        lo = np.concatenate([p[0][p[5]] for p in parts])
        hi = np.concatenate([p[1][p[5]] for p in parts])
        at = np.concatenate([p[2][p[5]] for p in parts])
        pmin = np.concatenate([p[3][p[5]] for p in parts])
        pmax = np.concatenate([p[4][p[5]] for p in parts])
    return tuple(np.concatenate(f) for f in found)


def _sorted_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted phrases of one range of suffixes."""
    data = pa.Table.from_batches(list(batches))
    if data.num_rows == 0:
        return
    data = data.combine_chunks()
    names = ["lang", *_WORDS]
    keys = np.stack([_codes(data.column(c).chunk(0) if data.column(c).num_chunks else data.column(c)) for c in names])
    weights = data.column("c").to_numpy().astype(np.int64)
    element, length, count, edge = three_way_counts(keys, weights, MIN_COUNT, shallowest=0)
    picked = data.take(pa.array(element, pa.int64()))
    words = [picked.column(w).to_pylist() for w in _WORDS]
    phrases = [" ".join(words[k][i] for k in range(d)) for i, d in enumerate(length.tolist())]
    yield pa.RecordBatch.from_arrays(
        [
            picked.column("lang").combine_chunks(),
            pa.array(phrases, pa.string()),
            pa.array(length, pa.int32()),
            pa.array(count, pa.int64()),
            pa.array(edge, pa.bool_()),
        ],
        names=["lang", "phrase", "len", "f", "edge"],
    )


def phrase_counts(docs: DataFrame, limit_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, len, f) of every phrase of 1 to 4 words with f >= MIN_COUNT, and (lang, n)."""
    texts = _texts(docs)
    heads = suffixes(texts, frequent_hashes(texts), limit_rows)
    counted = heads.repartitionByRange("lang", *_WORDS).mapInArrow(handing_back(_sorted_range), _SORTED)
    summed = counted.groupBy("lang", "phrase", "len").agg(F.sum("f").alias("f"))
    # Written once: the joins below read it several times.
    kept = stored(summed.filter(F.col("f") >= MIN_COUNT), "collocation-phrases")
    return kept.filter(F.col("len") > 0), kept.filter(F.col("len") == 0).select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, top: int = TOP, limit_rows: int = BROADCAST_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` collocations."""
    freq, totals = phrase_counts(docs, limit_rows)
    cands = freq.filter(F.col("len") >= 2).select("lang", "phrase", "len", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = cands.select("lang", "phrase", "len", "a", words.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "len",
        "a",
        "k",
        F.array_join(F.slice("ws", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("right"),
    )
    side = freq.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(side.withColumnRenamed("part", "left").withColumnRenamed("f", "l"), ["lang", "left"]).join(
        side.withColumnRenamed("part", "right").withColumnRenamed("f", "r"), ["lang", "right"]
    )
    big = "decimal(38,0)"
    score = F.expr(f"cast({SCALE} as {big}) * cast(a as {big}) div cast(l + r as {big})").cast("long")
    best = cuts.groupBy("lang", "phrase", "len", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    # Sub-phrases of 2 words or more inside each longer candidate, with the greatest count of such a candidate.
    spans = F.filter(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.col("len") - 2),
                lambda i: F.transform(F.sequence(F.lit(2), F.col("len") - i), lambda m: F.struct(i.alias("i"), m.alias("m"))),
            )
        ),
        lambda s: s["m"] < F.col("len"),
    )
    inner = cands.filter(F.col("len") >= 3).select("lang", words.alias("ws"), "a", F.explode(spans).alias("s"))
    inner = inner.select(
        "lang", F.array_join(F.slice("ws", F.col("s.i") + 1, F.col("s.m")), " ").alias("phrase"), F.col("a").alias("outer")
    )
    covering = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(covering, ["lang", "phrase"], "left").filter(
        F.col("outer").isNull() | (F.col("outer").cast(big) * 100 < F.col("a").cast(big) * KEEP_PERCENT)
    )
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("a").cast("long").alias("a"),
        F.col("b.l").cast("long").alias("l"),
        F.col("b.r").cast("long").alias("r"),
        F.col("n").cast("long").alias("n"),
        F.col("b.score").cast("long").alias("score"),
    )
