"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all ways to cut it into pieces, which the forward algorithm gives in one pass; the probability of a text is the
product over its words. Words are runs of letters, lower-cased, with the vocabulary's word-begin mark in front; runs
above ``LONGEST`` letters are read in pieces of that length. A letter that the vocabulary lacks is a piece of its own
with the probability ``UNKNOWN`` in every language.

Training is expectation maximisation over the labelled rows: every pass visits all of them, sums the expected number
of uses of each piece by language within the tasks, and combines the tasks' sums in Spark; the first pass starts from
pieces of equal probability per length. A model is one row per language and used piece, so its size is bounded by
the vocabulary and the number of languages, not by the corpus.

Prediction is per text: ``lang_pred`` is the most probable language (the first by name among equals), ``score`` its
posterior, from 0 to 1. A null text, or one without a letter, is ``und`` with score 0; so
is every text if nothing was learned. Rows without text or label are not learned from. ``doc_id`` may be null or repeated;
every row is predicted by itself. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import code_points, handing_back, mixed

VOCABULARY = "piece_bpe_32k"
UNDETERMINED = "und"
BEGIN = "▁"
LONGEST = 64
UNKNOWN = 1e-7
SMOOTHING = 0.1
PASSES = 1
# Words whose counts or probabilities a task holds at once, and texts that it reads at once.
REMEMBERED = 200_000
TEXTS = 512


@functools.cache
def pieces(vocabulary: str = VOCABULARY) -> tuple[str, ...]:
    """The vocabulary's pieces that words can consist of, by number."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i)))
    return tuple(n for n in names if n.removeprefix(BEGIN).isalpha() or n == BEGIN)


class Lattice:
    """Pieces at every place of a batch of words; hashes of substrings are looked up for all words at once."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.names = pieces(vocabulary)
        by_size: dict[int, dict[str, int]] = {}
        for i, name in enumerate(self.names):
            for size in range(1, len(name)):
                by_size.setdefault(size, {}).setdefault(name[:size], -1)
            by_size.setdefault(len(name), {})[name] = i
        # Of each size, the hashes of all beginnings of pieces, and the piece where the beginning is one.
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for size in sorted(by_size):
            begins = by_size[size]
            points = code_points("".join(begins)).reshape(-1, size).astype(np.uint64)
            keys = np.zeros(len(begins), np.uint64)
            for column in points.T:
                keys = mixed(keys + column + np.uint64(1))
            order = np.argsort(keys)
            self.tables.append((keys[order], np.fromiter(begins.values(), np.int64, len(begins))[order]))

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Offsets and lengths of the marked words, and for each size the piece that starts at a place (or -1)."""
        marked = [BEGIN + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        points = code_points("".join(marked)).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(points))
        found, at, value = {}, np.arange(len(points)), np.zeros(len(points), np.uint64)
        for size, (keys, numbers) in enumerate(self.tables, 1):
            # Only places where a piece can still go on are looked at again.
            longer = left[at] >= size
            at = at[longer]
            value = mixed(value[longer] + points[at + size - 1] + np.uint64(1))
            row = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            same = keys[row] == value
            at, value, row = at[same], value[same], row[same]
            if not len(at):
                break
            piece = numbers[row]
            whole = piece >= 0
            if whole.any():
                hit = np.full(len(points), -1, np.int32)
                hit[at[whole]] = piece[whole]
                found[size] = hit
        return starts, lengths, found


@functools.cache
def lattice(vocabulary: str) -> Lattice:
    """The lattice of this process; tasks of a worker share it."""
    return Lattice(vocabulary)


class Model:
    """Log probabilities of the words under every language, remembered up to a bound."""

    def __init__(
        self,
        languages: list[str],
        table: np.ndarray,
        prior: np.ndarray,
        vocabulary: str = VOCABULARY,
        remembered: int = REMEMBERED,
    ):
        self.languages, self.table, self.prior = languages, table, prior
        self.lattice = lattice(vocabulary)
        self.seen: dict[str, int] = {}
        self.values = np.zeros((remembered, len(languages)), np.float32)

    def forward(self, words: list[str]):
        """Scaled forward values at every place of every word; rows are places, columns languages."""
        starts, lengths, found = self.lattice.read(words)
        total, n = int(lengths.sum()) + len(words), len(self.languages)
        # A word of length m has m + 1 places.
        first = starts + np.arange(len(words))
        alpha = np.zeros((total, n))
        alpha[first] = 1.0
        for t in range(1, int(lengths.max()) + 1):
            alive = np.flatnonzero(lengths >= t)
            here, origin = first[alive] + t, starts[alive] + t
            sums = np.zeros((len(alive), n))
            single = found[1][origin - 1] if 1 in found else np.full(len(alive), -1)
            sums += alpha[here - 1] * np.where((single >= 0)[:, None], self.table[single], UNKNOWN)
            for size, hit in found.items():
                if 1 < size <= t:
                    piece = hit[origin - size]
                    some = np.flatnonzero(piece >= 0)
                    sums[some] += alpha[here[some] - size] * self.table[piece[some]]
            alpha[here] = sums
        return starts, lengths, found, first, alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Row per word, column per language; the logarithm of the sum over all segmentations."""
        _, lengths, _, first, alpha = self.forward(words)
        return np.log(np.maximum(alpha[first + lengths], 1e-300))

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, for words that occur ``weights`` times in each language."""
        starts, lengths, found, first, alpha = self.forward(words)
        beta = np.zeros_like(alpha)
        last = first + lengths
        beta[last] = weights / np.maximum(alpha[last], 1e-300)
        used, shares = [], []
        for t in range(int(lengths.max()) - 1, -1, -1):
            alive = np.flatnonzero(lengths > t)
            here, origin = first[alive] + t, starts[alive] + t
            sums = np.zeros((len(alive), len(self.languages)))
            single = found[1][origin] if 1 in found else np.full(len(alive), -1)
            known = (single >= 0)[:, None]
            step = beta[here + 1] * np.where(known, self.table[single], UNKNOWN)
            sums += step
            used.append(single[known[:, 0]])
            shares.append((alpha[here] * step)[known[:, 0]])
            for size, hit in found.items():
                if size > 1:
                    within = np.flatnonzero(lengths[alive] - t >= size)
                    piece = hit[origin[within]]
                    some = within[piece >= 0]
                    piece = piece[piece >= 0]
                    step = beta[here[some] + size] * self.table[piece]
                    sums[some] += step
                    used.append(piece)
                    shares.append(alpha[here[some]] * step)
            beta[here] = sums
        number, share = np.concatenate(used), np.concatenate(shares)
        uses = [np.bincount(number, share[:, i], len(self.lattice.names)) for i in range(len(self.languages))]
        return np.column_stack(uses)

    def of_texts(self, counts: list[Counter]) -> np.ndarray:
        """The log probability of every text (a count of its words) by language, without the prior.

        Words are remembered up to a number that bounds memory; then all are forgotten.
        """
        words = [w for c in counts for w in c]
        new = list(set(words) - self.seen.keys())
        if len(self.seen) + len(new) > len(self.values):
            self.seen = {}
            new = list(set(words))
            if len(new) > len(self.values):
                self.values = np.zeros((len(new), len(self.languages)), np.float32)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            n = len(self.seen)
            self.values[n : n + len(part)] = self.log_probabilities(part)
            self.seen.update(zip(part, range(n, n + len(part)), strict=True))
        number = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        times = np.fromiter((k for c in counts for k in c.values()), float, len(words))
        lengths = np.array([len(c) for c in counts])
        text = np.repeat(np.arange(len(counts)), lengths)
        values = self.values[number]
        return np.column_stack(
            [np.bincount(text, times * values[:, i], len(counts)) for i in range(len(self.languages))]
        )


# Letters, and the few other characters of words that are neither digits nor letters.
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """The words of a text and how often each occurs."""
    found = Counter(_RUN.findall(text.lower()))
    for run in [w for w in found if len(w) > LONGEST or not w.isalpha()]:
        times = found.pop(run)
        for letters in "".join(c if c.isalpha() else " " for c in run).split():
            for at in range(0, len(letters), LONGEST):
                found[letters[at : at + LONGEST]] += times
    return found


class WordCounts:
    """How often words occur in each language: a number for every word, and a row of an array."""

    def __init__(self, languages: int):
        self.languages = languages
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, self.languages), np.int64)

    def add(self, words: Counter, language: int) -> None:
        numbers = self.numbers
        at = [numbers.setdefault(w, len(numbers)) for w in words]
        if len(numbers) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(numbers), self.languages), np.int64)])
        self.rows[at, language] += np.fromiter(words.values(), np.int64, len(words))

    def parts(self, size: int) -> Iterator[tuple[list[str], np.ndarray]]:
        """``size`` words at a time with their counts."""
        words = iter(self.numbers)
        for at in range(0, len(self.numbers), size):
            part = list(itertools.islice(words, size))
            yield part, self.rows[at : at + len(part)]


def _start(languages: int) -> np.ndarray:
    """Pieces of equal probability per length; longer ones are rarer."""
    sizes = np.array([len(n) for n in pieces()])
    weight = 1.0 / (np.bincount(sizes)[sizes] * 4.0 ** (sizes - 1))
    return np.repeat((weight / weight.sum())[:, None], languages, axis=1)


def train(docs: DataFrame, passes: int = PASSES) -> Model | None:
    """The model of all rows that have ``text`` and ``lang``; null if there are none."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    seen = sorted(rows.groupBy("lang").count().collect())
    if not seen:
        return None
    languages = [r["lang"] for r in seen]
    prior = np.array([float(r["count"]) for r in seen])
    model = Model(languages, _start(len(languages)), np.log(prior / prior.sum()))
    column = {name: i for i, name in enumerate(languages)}
    for _ in range(passes):
        fixed = (languages, model.table, model.prior)

        def expect(batches: Iterator[pa.RecordBatch], fixed=fixed) -> Iterator[pa.RecordBatch]:
            own, sums = Model(*fixed, remembered=0), 0
            counts = WordCounts(len(languages))

            def spend():
                done = sum(own.expected(words, weights) for words, weights in counts.parts(10_000))
                counts.clear()
                return done

            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        counts.add(words_of(text), column[lang])
                        if len(counts.numbers) > REMEMBERED:
                            sums = sums + spend()
            sums = sums + spend()
            if isinstance(sums, np.ndarray):
                piece, lang = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(sums[piece, lang], pa.float64())],
                    ["piece", "lang", "uses"],
                )

        uses = rows.mapInArrow(handing_back(expect), "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        found = uses.toArrow()
        table = np.full(model.table.shape, SMOOTHING)
        np.add.at(
            table,
            (found.column("piece").to_numpy(), found.column("lang").to_numpy()),
            found.column("uses").to_numpy(),
        )
        model = Model(languages, table / table.sum(axis=0), model.prior)
    return model


def predict(docs: DataFrame, model: Model | None, carried: list[Column]) -> DataFrame:
    """The ``carried`` columns of every row with lang_pred and score."""
    rows = docs.select(*carried, docs["text"].cast("string").alias("__text"))
    names = [f.name for f in rows.schema.fields[:-1]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    fixed = model and (model.languages, model.table, model.prior)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*fixed) if fixed else None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                counts = [words_of(t or "") for t in part.column(len(names)).to_pylist()]
                lang, score = [UNDETERMINED] * len(counts), np.zeros(len(counts))
                if own and any(counts):
                    total = own.of_texts(counts) + own.prior
                    best = total.argmax(axis=1)
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    score = share.max(axis=1) / share.sum(axis=1)
                    lang = [own.languages[b] if c else UNDETERMINED for b, c in zip(best, counts, strict=True)]
                    score = np.where([bool(c) for c in counts], score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*names, "lang_pred", "score"],
                )

    return rows.mapInArrow(handing_back(guess), (kinds + ", " if kinds else "") + "lang_pred string, score double")


def held_out(docs: DataFrame) -> Column:
    """Whether a document is kept from training: the checksum of its doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that are not held out."""
    model = train(docs.filter(~held_out(docs)), passes)
    return predict(docs, model, [docs["doc_id"].alias("doc_id"), held_out(docs).alias("held_out")])


def keep_identified(docs: DataFrame, least: float = 0.5, passes: int = PASSES) -> DataFrame:
    """The rows whose language is determined with a score of at least ``least``, with all their columns."""
    model = train(docs.filter(~held_out(docs)), passes)
    found = predict(docs, model, [docs[name] for name in docs.columns])
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(docs.columns)
