"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every text becomes a fixed number of statistics of its characters, words and lines. They are standardised and mapped
by ``FOURIER`` random cosines, whose products approximate a Gaussian kernel. The normal equations of the ridge fit
are sums over rows: each task adds up its own, Spark sums the tasks', and only their sum, whose size is that of the
features squared, is solved on the driver. Raw scores are calibrated by isotonic regression over ``CELLS`` score
cells, counted in Spark. All labelled rows that may be learned from are used.

A null text counts as empty and has the statistics of an empty text. Rows without a label, and labels without a row,
are not learned from; several labels of a document are averaged. If nothing can be learned every score is 0.5.
``doc_id`` may be null (no label then) or repeated: every row is scored by itself. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import code_points, mixed, stored, whole_text, word_hashes

FOURIER = 192
WIDTH = 4.0
RIDGE = 1.0
CELLS = 2000
SEED = 11

STATISTICS = (
    "log_chars", "log_words", "log_lines", "upper", "digit", "space", "sentence_marks", "other_marks", "beyond_ascii",
    "word_length", "word_spread", "short_words", "long_words", "distinct_words", "top_word", "same_as_last",
    "distinct_triples", "distinct_lines", "repeated_in_lines", "line_length", "marks_per_word", "entropy", "longest_run",
    "shouting",
)

_LOWER, _UPPER, _DIGIT, _SPACE, _SENTENCE, _MARK = range(6)


def character_classes() -> np.ndarray:
    kinds = np.full(0x110000, _MARK, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isupper():
            kinds[c] = _UPPER
        elif ch.isalpha():
            kinds[c] = _LOWER
        elif ch.isdigit():
            kinds[c] = _DIGIT
        elif ch.isspace():
            kinds[c] = _SPACE
        elif ch in ".,;:!?'\"-()":
            kinds[c] = _SENTENCE
    return kinds


def _runs(values: np.ndarray) -> int:
    change = np.flatnonzero(np.diff(values)) + 1
    return int(np.diff(np.concatenate([[0], change, [len(values)]])).max())


def statistics(text: str, kinds: np.ndarray) -> np.ndarray:
    """The statistics of one text; shares of nothing are 0."""
    out = np.zeros(len(STATISTICS), np.float32)
    if not text:
        return out
    points = code_points(text)
    n = len(points)
    count = np.bincount(kinds[points], minlength=6) / n
    lines = [x for x in text.split("\n") if x.strip()]
    tokens = text.split()
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    words = word_hashes(text.lower())
    letters = count[_LOWER] + count[_UPPER]
    histogram = np.bincount(np.minimum(points, 255))
    p = histogram[histogram > 0] / n
    m = max(len(words), 1)
    _, times = np.unique(words, return_counts=True)
    triples = words[:-2] * np.uint64(3) + mixed(words[1:-1]) + words[2:] * np.uint64(7) if len(words) > 2 else words
    different = set(lines)
    out[:] = (
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        count[_UPPER] / max(letters, 1e-9),
        count[_DIGIT],
        count[_SPACE],
        count[_SENTENCE],
        count[_MARK],
        (points > 127).mean(),
        lengths.mean() if len(tokens) else 0,
        lengths.std() if len(tokens) else 0,
        (lengths <= 3).mean() if len(tokens) else 0,
        (lengths >= 16).mean() if len(tokens) else 0,
        len(times) / m,
        times.max(initial=0) / m,
        (words[1:] == words[:-1]).sum() / m,
        len(np.unique(triples)) / max(len(triples), 1),
        len(different) / max(len(lines), 1),
        1 - sum(map(len, different)) / max(sum(map(len, lines)), 1),
        np.log1p(n / max(len(lines), 1)),
        (count[_SENTENCE] + count[_MARK]) * n / m,
        -(p * np.log2(p)).sum(),
        np.log1p(_runs(points)),
        sum(t.isupper() and len(t) > 2 for t in tokens) / max(len(tokens), 1),
    )
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(docs["doc_id"].alias("doc_id"), held_out(docs).alias("held_out"), whole_text(docs).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = character_classes()
        for batch in batches:
            rows = [statistics(t, kinds) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32), pa.float32())
            ends = pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "held_out", "statistics"],
            )

    return texts.mapInArrow(describe, f"doc_id {kind}, held_out boolean, statistics array<float>")


def held_out(docs: DataFrame) -> Column:
    """Whether a label may not be learned from: the checksum of the doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("statistics").flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(batch.num_rows, len(STATISTICS))


class Model:
    """Standardisation, random directions, ridge weights and the calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.directions = draw.normal(0, 1 / WIDTH, (len(STATISTICS), FOURIER))
        self.phases = draw.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(1 + len(STATISTICS) + FOURIER)
        self.levels = np.full(CELLS, 0.5)

    def features(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / FOURIER) * np.cos(x @ self.directions + self.phases)
        return np.hstack([np.ones((len(x), 1)), 0.1 * x, waves])

    def cells(self, statistics: np.ndarray) -> np.ndarray:
        raw = self.features(statistics) @ self.weights
        return np.clip(((raw + 0.5) / 2 * CELLS).astype(np.int64), 0, CELLS - 1)

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        return self.levels[self.cells(statistics)]


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing shares closest to ``good / total``, weighted by ``total``; empty cells are interpolated."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total > 0):
        blocks.append([good[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    if not blocks:
        return np.full(len(total), 0.5)
    at = [x for b in blocks for x in (b[2], b[3])]
    share = [x for b in blocks for x in (b[0] / b[1],) * 2]
    return np.interp(np.arange(len(total)), at, share)


def train(known: DataFrame) -> Model:
    """The model of the rows of ``known`` (statistics, quality)."""
    size = len(STATISTICS)
    parts = [f(F.col("statistics")[i].cast("double")) for i in range(size) for f in (F.avg, F.stddev_pop)]
    first = known.agg(F.count("*"), *parts).first()
    if not first[0]:
        return Model(np.zeros(size), np.ones(size))
    moments = np.array(first[1:]).reshape(size, 2)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-6))
    width = len(model.weights) + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = np.hstack([model.features(_matrix(batch)), batch.column("quality").to_numpy()[:, None]])
            total += z.T @ z
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"]
        )

    sums = known.mapInArrow(add_up, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    normal = np.zeros((width, width))
    normal[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    normal = normal + np.triu(normal, 1).T
    model.weights = np.linalg.solve(normal[:-1, :-1] + RIDGE * np.eye(width - 1), normal[:-1, -1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.cells(_matrix(batch)), pa.int32()), batch.column("quality")], ["cell", "quality"]
            )

    cells = known.mapInArrow(place, "cell int, quality double").groupBy("cell")
    cells = cells.agg(F.sum("quality").alias("good"), F.count("*").alias("n")).toArrow()
    good, total = np.zeros(CELLS), np.zeros(CELLS)
    at = cells.column("cell").to_numpy()
    good[at], total[at] = cells.column("good").to_numpy(), cells.column("n").to_numpy()
    model.levels = isotonic(good, total)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = stored(described(docs), "quality-statistics")
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    marks = stored(marks.agg(F.avg(F.col("quality").cast("double")).alias("quality")), "quality-labels")
    known = rows.filter("NOT held_out").join(marks, "doc_id").select("statistics", "quality")
    model = train(stored(known, "quality-known"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(model.scores(_matrix(batch)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(values, pa.float64()),
                    pa.array((values >= threshold).astype(np.int32), pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
