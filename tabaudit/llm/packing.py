"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids with an end mark, and only those above the capacity are cut: into full pieces, the first of
which may be shorter. A full piece is a sequence of its own. The rest is dealt by a hash over blocks of about
``BLOCK`` pieces, so that a task's memory does not grow with the table. In each block several islands evolve packings:

* an individual is a list of bins; the first comes from best fit over falling lengths, the others from disturbed orders;
* crossover injects whole well-filled bins of one parent into the other, dissolves the bins that hold a duplicate, and
  puts the displaced pieces back by best fit; mutation dissolves poorly filled bins;
* after each epoch every island sends its best individual to the next island; a block ends early when an individual
  reaches the lower bound of its size.

The best individual of all islands wins. Pieces in bins that are not nearly full are pooled over all blocks and packed
once more the same way. Nothing is dropped: every piece has one place.

A null text counts as empty and gives one piece that is the end mark. ``doc_id`` may be null or repeated: every row is
a document of its own. An empty table gives an empty result; other columns are not looked at. Runs repeat exactly for
the same input files.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import handing_back, stored, whole_text
from tabaudit.llm.tokens import encoder

CAPACITY = 2048
END_MARK = 0
VOCABULARY = "byte_bpe_50k"

BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
NEARLY_FULL = 0.98


# --- documents to pieces ----------------------------------------------------------------------------------------


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1), strict=True))


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """row, doc_id, piece, start, length and ids (unsigned 32-bit, little-endian) of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"))
    end = np.array([END_MARK], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, row = encoder(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, piece, start, length, ids = [], [], [], [], []
                for n, text in enumerate(part.column("text").to_pylist()):
                    whole = ids_of(text) + end
                    for k, (a, size) in enumerate(cut(len(whole) // 4, capacity)):
                        owner.append(n)
                        piece.append(k)
                        start.append(a)
                        length.append(size)
                        ids.append(whole[4 * a : 4 * (a + size)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + len(owner)), pa.int64()),
                        part.column("doc_id").take(pa.array(owner, pa.int32())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["row", "doc_id", "piece", "start", "length", "ids"],
                )
                row += len(owner)

    return texts.mapInArrow(handing_back(encode), f"row long, doc_id {kind}, piece int, start long, length long, ids binary")


# --- the grouping genetic algorithm of one island ----------------------------------------------------------------


class Packing:
    """Bins of piece numbers with their fill, and the best-fit search among their free places."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.fill = [sum(sizes[i] for i in b) for b in self.bins]

    def add(self, pieces: list[int]) -> Packing:
        """Put ``pieces`` in, each where it leaves the least room; a bit per amount of room finds the place."""
        by_room: dict[int, list[int]] = {}
        rooms = 0
        for n, fill in enumerate(self.fill):
            by_room.setdefault(self.capacity - fill, []).append(n)
            rooms |= 1 << (self.capacity - fill)
        for i in pieces:
            size = self.sizes[i]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                there = by_room[room]
                n = there.pop()
                if not there:
                    rooms ^= 1 << room
                self.bins[n].append(i)
                self.fill[n] += size
            else:
                n, room = len(self.bins), self.capacity
                self.bins.append([i])
                self.fill.append(size)
            left = room - size
            by_room.setdefault(left, []).append(n)
            rooms |= 1 << left
        return self

    def cost(self) -> tuple[int, int]:
        """Bins first; among equals the packing with fuller and emptier bins is better."""
        return len(self.bins), -sum(f * f for f in self.fill)

    def labels(self) -> list[int]:
        out = [0] * len(self.sizes)
        for n, b in enumerate(self.bins):
            for i in b:
                out[i] = n
        return out


def packing_of(labels: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, n in enumerate(labels):
        bins[n].append(i)
    return Packing(sizes, capacity, [b for b in bins if b])


def crossover(one: Packing, other: Packing, draw: random.Random) -> Packing:
    """Bins of ``other`` that are well filled go into ``one`` whole; displaced pieces are best-fitted."""
    ranked = sorted(range(len(other.bins)), key=lambda n: -other.fill[n])
    pool = ranked[: max(1, len(ranked) // 2)]
    chosen = draw.sample(pool, max(1, len(pool) // 4))
    injected = {i for n in chosen for i in other.bins[n]}
    kept = [b for b in one.bins if injected.isdisjoint(b)]
    displaced = [i for b in one.bins if not injected.isdisjoint(b) for i in b if i not in injected]
    child = Packing(one.sizes, one.capacity, [list(b) for b in kept] + [list(other.bins[n]) for n in chosen])
    return _refilled(child, displaced, draw)


def _refilled(child: Packing, displaced: list[int], draw: random.Random) -> Packing:
    """Mutation: the emptiest bins and one other are dissolved; then best fit over falling lengths."""
    order = sorted(range(len(child.bins)), key=lambda n: child.fill[n])
    gone = set(order[:2]) | ({draw.choice(order)} if order else set())
    displaced = displaced + [i for n in gone for i in child.bins[n]]
    left = Packing(child.sizes, child.capacity, [b for n, b in enumerate(child.bins) if n not in gone])
    return left.add(sorted(displaced, key=lambda i: -child.sizes[i]))


def evolve(
    sizes: list[int], capacity: int, seed: int, immigrants: list[Packing], generations: int, population: int
) -> list[Packing]:
    """The individuals of one island after some generations, best first."""
    draw = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    people = list(immigrants)
    if not people:
        people = [Packing(sizes, capacity).add(sorted(range(len(sizes)), key=lambda i: -sizes[i]))]
    while len(people) < population and len(people[0].bins) > bound:
        spread = 1 + 0.2 * len(people)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * draw.uniform(1, spread))
        people.append(Packing(sizes, capacity).add(order))
    people.sort(key=Packing.cost)
    for _ in range(generations):
        if len(people[0].bins) <= bound or len(people) < 2:
            break
        for _ in range(population):
            a, b = draw.sample(people, 2)
            people.append(crossover(a, b, draw))
        people.sort(key=Packing.cost)
        del people[population:]
    return people


# --- islands as Spark groups --------------------------------------------------------------------------------------

_PEOPLE = "block long, island int, rank int, bins int, squares long, labels binary"


def _bytes(labels: list[int]) -> bytes:
    return zlib.compress(np.array(labels, "<i4").tobytes(), 1)


def _labels(data: bytes) -> list[int]:
    return np.frombuffer(zlib.decompress(data), "<i4").tolist()


def _individual(block: int, island: int, rank: int, p: Packing) -> tuple:
    bins, squares = p.cost()
    return block, island, rank, bins, squares, _bytes(p.labels())


def _pack_blocks(pieces: DataFrame, capacity: int, blocks: int, level: int) -> DataFrame:
    """``pieces`` (row, length) with block, bin, offset and fill of its bin."""
    block = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)).alias("block")
    dealt = stored(pieces.select("row", "length", block), "packing-blocks")
    on_islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))

    def epoch(key, items: pd.DataFrame, arrivals: pd.DataFrame) -> pd.DataFrame:
        name, island = int(key[0]), int(key[1])
        items = items.sort_values("row")
        sizes = items["length"].tolist()
        came = arrivals.sort_values(["bins", "squares", "rank"])["labels"]
        people = [packing_of(_labels(x), sizes, capacity) for x in came]
        people = evolve(sizes, capacity, name * 31 + island, people, GENERATIONS, POPULATION)
        stay = [_individual(name, island, n, p) for n, p in enumerate(people)]
        travels = _individual(name, (island + 1) % ISLANDS, POPULATION, people[0])
        return pd.DataFrame([*stay, travels], columns=[c.split()[0] for c in _PEOPLE.split(", ")])

    people = pieces.sparkSession.createDataFrame([], _PEOPLE)
    for _ in range(EPOCHS):
        people = (
            on_islands.groupBy("block", "island")
            .cogroup(people.groupBy("block", "island"))
            .applyInPandas(epoch, _PEOPLE)
        )
        people = stored(people, "packing-people")
    best = people.groupBy("block").agg(F.min(F.struct("bins", "squares", "island", "rank", "labels"))["labels"].alias("labels"))

    def placed(key, items: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("row").reset_index(drop=True)
        items["bin"] = _labels(won["labels"].iloc[0])
        before = items.groupby("bin")["length"].cumsum()
        items["offset"] = before - items["length"]
        items["fill"] = items.groupby("bin")["length"].transform("sum")
        return items[["row", "block", "bin", "offset", "fill"]]

    return (
        dealt.groupBy("block")
        .cogroup(best.groupBy("block"))
        .applyInPandas(placed, "row long, block long, bin int, offset long, fill long")
    )


def assign(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """row, sequence_id and offset of every piece; ``pieces`` (row, length) must be a written table."""
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    number = lambda level, low: F.lit(level).cast("long") * F.lit(1 << 60) + low
    bins = F.col("block") * F.lit(1 << 20) + F.col("bin")
    done = full.select("row", number(0, F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = max(1, -(-rest.count() // block))
    first = stored(_pack_blocks(rest.select("row", "length"), capacity, blocks, 1), "packing-first")
    if blocks == 1:
        return done.unionByName(first.select("row", number(1, bins).alias("sequence_id"), "offset"))
    nearly = F.col("fill") >= NEARLY_FULL * capacity
    kept = first.filter(nearly).select("row", number(1, bins).alias("sequence_id"), "offset")
    pooled = rest.join(first.filter(~nearly).select("row"), "row", "left_semi").select("row", "length")
    pooled = stored(pooled, "packing-pooled")
    blocks = max(1, -(-pooled.count() // block))
    second = _pack_blocks(pooled, capacity, blocks, 2).select("row", number(2, bins).alias("sequence_id"), "offset")
    return done.unionByName(kept).unionByName(second)


def packed(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; its ids too if asked for."""
    pieces = encode_pieces(docs, capacity, vocabulary).withColumn("ids_crc32", F.crc32("ids"))
    pieces = stored(pieces if with_ids else pieces.drop("ids"), "packing-pieces")
    places = assign(pieces.select("row", "length"), capacity)
    return pieces.join(places, "row").drop("row")
