"""Helpers shared by the operators: stored intermediate tables, row numbers, hashed words, ASCII lower case."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.session import checkpoint_dir

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, removed by Hadoop when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, safe from lost executors, with no partitioning left over."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, LETTERS, LETTERS.lower())


def split_lower(text: Column, delimiters: str, mark: str = " ") -> Column:
    """The runs of ``text`` between characters of ``delimiters``, lower-cased in A-Z; empty runs are dropped.

    One translate maps A-Z to a-z and every delimiter to ``mark``, and the text is split at that single character:
    several times faster than a regular expression over the same classes, with the same words.
    """
    mapped = F.translate(text, LETTERS + delimiters, LETTERS.lower() + mark * len(delimiters))
    return F.array_remove(F.split(mapped, mark), "")


def ascii_ranges(*ranges: tuple[int, int]) -> str:
    """The characters of the given inclusive code point ranges."""
    return "".join(chr(c) for lo, hi in ranges for c in range(lo, hi + 1))


def whole_text(docs: DataFrame, column: str = "text") -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch with the number of its first row, unique over all tasks of a stage."""
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        yield at, batch
        at += batch.num_rows


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def handing_back(function: Callable) -> Callable:
    """``function`` of batches; at the end of a task its freed memory goes back to the system.

    Workers are kept for later tasks and stages, so what they hold would add up beside the executor's own memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _hand_back()

    return run


@functools.cache
def _letters_and_digits() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of code points that are ``inside`` the set."""
    flag = np.zeros(len(points) + 2, np.int8)
    flag[1:-1] = inside[points]
    change = np.diff(flag)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(text: str, inside: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every word of ``text``, in order; words are runs of letters and digits by default.

    The hash of a word is a polynomial of its code points, taken for all words at once from prefix sums.
    """
    return hashes_of_points(code_points(text), _letters_and_digits() if inside is None else inside)


def hashes_of_points(points: np.ndarray, inside: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(points, inside)
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.full(len(points), _ODD, np.uint64))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64, out=sums[1:])
    back = np.multiply.accumulate(np.full(len(points), _INVERSE, np.uint64))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * _ODD + words[i : i + n])
    return out
