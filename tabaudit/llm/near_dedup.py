"""Near-duplicate classes by order min-hash, verified by banded alignment.

Texts are read as words (runs of letters and digits, any case) and shingles of ``SHINGLE`` consecutive words; a text
with fewer words is one shingle. Equal shingles of a text are told apart by their occurrence number. A sketch picks
the ``PICKED`` shingles with the least keyed hashes and keeps them in text order, so that two texts agree on it with a
probability that falls with edits and with changes of order; every text has ``SKETCHES`` of them. The similarity of
two texts is the number of shingles in their longest common order-preserving alignment, divided by the number of
different ones. Pairs of ``LEAST`` or more are links; classes are the connected components.

Candidates agree on two sketches at least: a pair at the threshold does so with a probability above 0.9999.

* Texts with equal words are one node; copies are not paired.
* Buckets of one sketch and up to ``PAIRED`` nodes emit their pairs. Larger ones are split by second sketches.
* What is still larger is a group of texts that are alike. Its nodes are compared with the three best-connected nodes of
  the bucket, which connects most of a group without its square of pairs. Pairs that are then in different components are
  found by their rarest shingles: similar texts share one of the rarest fifth, so no link between the nodes of a large
  bucket is lost, whatever its size. Rarest is by counts of shingles by hash, a table of bounded size: any order that is
  the same for all texts finds the same links, so two shingles may share a count.

Alignment is exact within the band of diagonals that a pair of the threshold can use: occurrence-labelled shingles
are unique, so the alignment is the longest increasing run of matches.

A text without words (null, empty) is a class of its own. ``doc_id`` may be null or repeated: every row has a class;
``class_id`` is its smallest doc_id, and the row with the largest doc_id is kept (one of them among equals). An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import handing_back, mixed, numbered, rolling, stored, whole_text, word_hashes

SHINGLE = 5
LEAST = 0.8
SKETCHES = 20
PICKED = 3
PAIRED = 32
SLOTS = 1 << 20
BLOCK = 1 << 12
# Most bucket sizes that are broadcast to the tasks with the buckets; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


# --- one text -----------------------------------------------------------------------------------------------------


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle together with how often the same shingle stood before it."""
    if not len(words):
        return np.zeros(0, np.uint64)
    hashes = rolling(words, min(size, len(words)))
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return hashes
    place = np.arange(len(hashes))
    begin = np.maximum.accumulate(np.where(same, 0, place))
    before = np.zeros(len(hashes), np.uint64)
    before[order] = (place - begin).astype(np.uint64)
    return np.where(before > 0, mixed(hashes + before * np.uint64(0xD1342543DE82EF95)), hashes)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """Per seed, a hash of the picked shingles in text order."""
    n = len(shingles)
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // max(n, 1))
    for at in range(0, SKETCHES, step):
        seeds = _SEEDS[at : at + step]
        if n <= PICKED:
            picked = np.repeat(shingles[None, :], len(seeds), axis=0)
        else:
            keyed = mixed(shingles[None, :] ^ seeds[:, None])
            places = np.sort(np.argpartition(keyed, PICKED - 1, axis=1)[:, :PICKED], axis=1)
            picked = shingles[places]
        value = seeds.copy()
        for column in picked.T:
            value = mixed(value + column)
        out[at : at + step] = value
    return out


def _increasing(values: np.ndarray) -> int:
    if (np.diff(values) > 0).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Aligned share of the labelled shingles of two texts; 0 where it must be below ``least``."""
    total = len(a) + len(b)
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not total or len(common) < least * (total - len(common)):
        return 0.0
    # Aligned pairs of a qualifying alignment lie no further apart than its unaligned shingles.
    band = int(total * (1 - least) / (1 + least)) + 1
    near = np.abs(at_a - at_b) <= band
    order = np.argsort(at_a[near])
    aligned = _increasing(at_b[near][order])
    share = aligned / (total - aligned)
    return share if share >= least else 0.0


# --- all texts ----------------------------------------------------------------------------------------------------


def sketched(docs: DataFrame) -> DataFrame:
    """row (unique, spread over all 64-bit values), doc_id, digest, node, sketches and words of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = whole_text(docs)
    texts = docs.select(
        docs["doc_id"].alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text")
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, batch in numbered(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, sketch, words = [], [], []
                for text in part.column("text").to_pylist():
                    own = word_hashes(text.lower()).astype(np.uint32).astype("<u4")
                    words.append(own.tobytes())
                    if len(own):
                        node.append(hashlib.blake2b(words[-1], digest_size=16).digest())
                        sketch.append(sketches(labelled_shingles(own.astype(np.uint64))).view(np.int64))
                    else:
                        node.append(None)
                        sketch.append(np.zeros(0, np.int64))
                rows = np.arange(first + at, first + at + part.num_rows, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mixed(rows + np.uint64(1)).view(np.int64)),
                        part.column("doc_id"),
                        part.column("digest"),
                        pa.array(node, pa.binary()),
                        pa.array(sketch, pa.list_(pa.int64())),
                        pa.array(words, pa.binary()),
                    ],
                    ["row", "doc_id", "digest", "node", "sketches", "words"],
                )

    return texts.mapInArrow(
        handing_back(sketch), f"row long, doc_id {kind}, digest string, node binary, sketches array<long>, words binary"
    )


def _sized(buckets: DataFrame, name: str) -> DataFrame:
    """``buckets`` (node, bucket) of two nodes or more with their number of nodes."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = stored(sizes.filter("n > 1"), name)
    return buckets.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "bucket")


def _with_popular(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of large buckets with three centres.

    A centre is, of each third of the nodes, the one that shares most with others everywhere.

    The text from which a group of edited ones descends is like all of them, and meets them more often than they do
    each other.
    """
    large = buckets.filter(F.col("n") > PAIRED).select("node", "bucket", "n")
    weight = large.groupBy("node").agg(F.sum("n").alias("weight"))
    third = F.pmod("node", F.lit(3))
    best = [F.max(F.when(third == i, F.struct("weight", "node"))).getField("node") for i in range(3)]
    first = large.join(weight, "node").groupBy("bucket").agg(F.array_compact(F.array(*best)).alias("centres"))
    star = large.join(first, "bucket").select("node", F.explode("centres").alias("centre")).filter("node <> centre")
    return star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _within(buckets: DataFrame) -> DataFrame:
    """All pairs inside buckets of bounded size, with the number of buckets that they share."""
    left = buckets.select("bucket", F.col("node").alias("a"))
    right = buckets.select("bucket", F.col("node").alias("b"))
    return left.join(right, "bucket").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def _pairs(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes to be verified, and the nodes of buckets not compared pairwise.

    ``sketches`` has node and sketches.
    """
    one = _sized(sketches.select("node", F.explode("sketches").alias("bucket")), "near-sizes")
    one = stored(one, "near-buckets")
    small = _within(one.filter(F.col("n") <= PAIRED)).filter("shared > 1")
    # A large bucket is split by each sketch that stands up to two places from its own.
    large = one.filter(F.col("n") > PAIRED).select("node", F.col("bucket").alias("first")).join(sketches, "node")
    at = F.array_position("sketches", F.col("first")).cast("int") - 1
    around = F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])
    second = F.transform(around, lambda d: F.get("sketches", F.pmod(at + d, F.lit(SKETCHES))))
    two = large.select("node", "first", F.explode(second).alias("second"))
    key = F.xxhash64(F.least("first", "second"), F.greatest("first", "second"))
    two = stored(two.select("node", key.alias("bucket")).distinct(), "near-two")
    two = stored(_sized(two, "near-two-sizes"), "near-two-buckets")
    pairs = small.select("a", "b").union(_with_popular(two))
    pairs = pairs.union(_within(two.filter(F.col("n") <= PAIRED)).select("a", "b")).distinct()
    return pairs, two.filter(F.col("n") > PAIRED).select("node").distinct()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The nodes of some texts (node, words) and their shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            own = [labelled_shingles(np.frombuffer(w.as_py(), "<u4").astype(np.uint64)) for w in part.column(1)]
            yield part.column(0).to_numpy(), own


def _slot(shingles: np.ndarray, slots: int) -> np.ndarray:
    return (shingles % np.uint64(slots)).astype(np.int64)


def _counted(texts: DataFrame) -> np.ndarray:
    """How many shingles of the texts (node, words) fall into each slot; tasks send their counts by blocks of slots."""
    size = SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, own in _shingled(batches):
            slots, n = np.unique(_slot(np.concatenate(own), size), return_counts=True)
            total[slots] += n
        slots = np.flatnonzero(total)
        blocks, first = np.unique(slots // BLOCK, return_index=True)
        ends = pa.array([*first, len(slots)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks, pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(slots, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(total[slots], pa.int64())),
            ],
            ["block", "slots", "n"],
        )

    def add(block: pa.Table) -> pa.Table:
        slots, n = (block.column(name).combine_chunks().flatten().to_numpy() for name in ("slots", "n"))
        order = np.argsort(slots)
        found, first = np.unique(slots[order], return_index=True)
        sums = np.add.reduceat(n[order], first)
        return pa.table({"slots": pa.array([found], pa.list_(pa.int32())), "n": pa.array([sums], pa.list_(pa.int64()))})

    parts = texts.mapInArrow(count, "block int, slots array<int>, n array<long>")
    found = parts.groupBy("block").applyInArrow(add, "slots array<int>, n array<long>").toArrow()
    counts = np.ones(size, np.int64)
    if found.num_rows:
        slots, n = (found.column(name).combine_chunks().flatten().to_numpy() for name in ("slots", "n"))
        counts[slots] = n
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """bucket, node, size and place: the rarest shingles of every text (node, words), with their places from the rarest.

    A text of ``least`` similarity has at least that share of the other one's shingles, so it cannot miss all of the
    rarest ones that are taken. Shingles that no other text has keep their places and are left out.
    """
    texts = stored(texts, "near-alike-texts")
    counts = _counted(texts)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, own in _shingled(batches):
            sizes = np.array([len(x) for x in own])
            taken = sizes - np.ceil(sizes * least - 1e-9).astype(np.int64) + 1
            buckets, places = [], []
            for x, n in zip(own, taken.tolist(), strict=True):
                many = counts[_slot(x, len(counts))]
                rarest = np.lexsort((x, many))[:n]
                place = np.flatnonzero(many[rarest] > 1)
                buckets.append(x[rarest[place]])
                places.append(place + 1)
            taken = np.array([len(x) for x in buckets])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(buckets).view(np.int64)),
                    pa.array(np.repeat(nodes, taken)),
                    pa.array(np.repeat(sizes, taken), pa.int32()),
                    pa.array(np.concatenate(places), pa.int32()),
                ],
                ["bucket", "node", "size", "place"],
            )

    return texts.mapInArrow(mark, "bucket long, node long, size int, place int")


def _across(prefixes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles and can be similar.

    Of two components of a bucket one is not its largest: only the nodes of the others are joined with all.
    """
    rows = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stored(rows, "near-prefixes")
    parts = rows.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket")
    parts = parts.agg(F.max(F.struct("n", "root")).getField("root").alias("most"), F.count("*").alias("parts"))
    rows = stored(rows.join(parts.filter("parts > 1").select("bucket", "most"), "bucket"), "near-across")
    x, y = rows.filter("root <> most").alias("x"), rows.alias("y")
    # What is common lies at or behind the first shared place, in both.
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1
    alike = left >= (F.col("x.size") + F.col("y.size")) * (least / (1 + least)) - 1e-9
    once = F.expr("x.root <> y.root AND (y.root = y.most OR x.node < y.node)")
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & once & alike)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def verified(pairs: DataFrame, words: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) of ``least`` similarity or more; ``words`` has the words of each row."""
    # Written first, so that a small set of rows is known to be small and the texts need not be shuffled to find its own.
    needed = stored(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "near-needed")
    texts = stored(words.join(needed, "row", "left_semi").select("row", "words"), "near-texts")
    met = pairs.join(texts.select(F.col("row").alias("a"), F.col("words").alias("wa")), "a")
    met = met.join(texts.select(F.col("row").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = (labelled_shingles(np.frombuffer(w.as_py(), "<u4").astype(np.uint64)) for w in (x, y))
                if similarity(one, two, least) >= least:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    return met.mapInArrow(handing_back(align), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of the graph; each round joins nodes to their least neighbour and contracts."""
    current, steps = stored(edges.select("a", "b").distinct(), "near-edges"), []
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        onward = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = least.join(onward, "to").select("node", F.col("further").alias("root"))
        step = stored(step, "near-step")
        steps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        joined = current.join(a, "a").join(b, "b").filter("x <> y")
        current = stored(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-edges")
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    members = steps[0]
    for step in steps[1:]:
        moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        members = members.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return members


def links(sketches: DataFrame, words: DataFrame, least: float = LEAST) -> DataFrame:
    """Similar pairs (a, b); of groups that are alike, enough of them to connect each."""
    pairs, alike = _pairs(sketches)
    pairs, alike = stored(pairs, "near-pairs"), stored(alike, "near-alike")
    found = stored(verified(pairs, words, least), "near-links")
    if alike.isEmpty():
        return found
    texts = words.join(alike.select(F.col("node").alias("row")), "row", "left_semi")
    prefixes = _prefixes(texts.select(F.col("row").alias("node"), "words"), least)
    more = _across(prefixes, components(found), least).join(pairs, ["a", "b"], "left_anti")
    return found.union(stored(verified(stored(more, "near-more"), words, least), "near-links"))


def _classed(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and the classes."""
    base = stored(sketched(docs), "near-sketches")
    # Texts with equal words are one node, named by one of their rows.
    named = base.filter("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("name"))
    named = stored(named, "near-nodes")
    names = named.select(F.col("name").alias("row"))
    single = base.select("row", "sketches").join(names, "row", "left_semi")
    single = stored(single.select(F.col("row").alias("node"), "sketches"), "near-single")
    edges = links(single, base.select("row", "words"), least)
    roots = components(edges).select(F.col("node").alias("name"), "root")
    whose = named.join(roots, "name", "left").select("node", F.coalesce("root", "name").alias("class"))
    whose = stored(whose, "near-whose")
    rows = base.select("row", "doc_id", "digest", "node").join(whose, "node", "left")
    rows = stored(rows.select("row", "doc_id", "digest", F.coalesce("class", "row").alias("class")), "near-rows")
    classes = rows.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.max(F.struct("doc_id", "row")).alias("stays")
    )
    return rows, stored(classes, "near-classes")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, class_size and kept of every document."""
    rows, classes = _classed(docs, least)
    return rows.join(classes, "class").select(
        "doc_id", "class_id", "class_size", (F.col("row") == F.col("stays.row")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The row that is kept of every class, with all its columns.

    Rows that repeat both doc_id and text are not told apart here; exact deduplication goes first.
    """
    rows, classes = _classed(docs, least)
    stays = classes.select(F.col("stays.row").alias("row"))
    keys = stored(rows.join(stays, "row", "left_semi").select("doc_id", "digest"), "near-stay")
    digest = F.sha2(whole_text(docs).cast("binary"), 256)
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & (digest == keys["digest"]), "left_semi")
