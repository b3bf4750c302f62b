"""Sub-word ids by merges with seeded dropout, and lossless decoding.

A text becomes the characters of a public piece vocabulary, spaces written as its space mark. An agenda holds every pair
of neighbours that is a piece; the pair with the best score is merged first, the leftmost among equals. A candidate
is skipped with probability ``dropout``: by a hash keyed with the seed, the document, the word, its occurrence, the
place and the piece, so that the same seed gives the same ids everywhere and another seed gives others. The document
enters with its ``doc_id`` and the hash of its text. Without dropout the ids are those of the vocabulary's own encoder. Pieces
never span the begin of a word, so words are encoded by themselves.

Documents are encoded some at a time. All occurrences of words of one length are rows of a matrix: each step takes the
next candidate of every row, skips or merges it, and looks the new neighbours up in a table of all pairs of symbols that
make a piece. Nothing is remembered between the documents, so memory does not grow with the words of a corpus.

Characters that the vocabulary lacks, and the space mark itself where a text has it, become their bytes. Decoding
joins pieces and bytes and gives back the text exactly. A null text counts as empty and has no ids. ``doc_id`` may be
null or repeated; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from tabaudit.llm.common import code_points, whole_text

VOCABULARY = "piece_bpe_32k"
DROPOUT = 0.1
SEED = 7
SPACE = "▁"
# Words with their spaces; the space mark of the vocabulary is put in when a word is encoded.
UNIT = re.compile(" *[^ ]+| +")
# Characters and documents that are encoded at once, and symbols of a matrix.
TOGETHER = 1 << 20
ROWS = 256
CELLS = 1 << 20
SHORT = 48
NEVER = 1 << 30
PLACE = 0x9E3779B97F4A7C15
PIECE = 0xD1342543DE82EF95
ADDENDS = [place * PLACE & 0xFFFFFFFFFFFFFFFF for place in range(SHORT)]


def _spread(key: int, occurrence: int) -> int:
    """Mixed, since the keys of a word in many documents and places differ in few bits."""
    x = (key + occurrence * 0xA0761D6478BD642F) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF


def _spread_all(keys: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    x = (keys + occurrences.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _times_before(numbers: np.ndarray) -> np.ndarray:
    """How often each number stood before its place."""
    order = np.argsort(numbers, kind="stable")
    new = np.ones(len(numbers), bool)
    new[1:] = numbers[order][1:] != numbers[order][:-1]
    place = np.arange(len(numbers))
    out = np.empty(len(numbers), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


class _Pairs:
    """The piece that two neighbouring symbols make, or -1: a table of hashes with linear probing."""

    def __init__(self, symbols: dict[str, int], pieces: dict[str, int]):
        whole, left, right = [], [], []
        for piece, i in pieces.items():
            for at in range(1, len(piece)):
                a, b = symbols.get(piece[:at]), symbols.get(piece[at:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] == -1]
            # Of those that meet at a free slot the last written stays; the others go on.
            self.keys[at[free]] = keys[free]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
        self.values[at] = np.array(whole, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(PLACE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return out


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def document_key(doc_id: object, text: str) -> int:
    """The key of a document: equal texts under other ids have other keys."""
    name = xxhash.xxh64_intdigest(repr(doc_id).encode("utf-8", "surrogatepass"))
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), name)


class Codec:
    """The pieces of a vocabulary with their scores and bytes."""

    def __init__(self, vocabulary: str = VOCABULARY, dropout: float = DROPOUT, seed: int = SEED):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.of_byte: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            data = name.replace(SPACE, " ").encode()
            if model.is_byte(i):
                value = int(name[3:-1], 16)
                self.of_byte[value] = i
                data = bytes([value])
            elif model.is_control(i) or model.is_unknown(i):
                data = b""
            else:
                self.ids[name] = i
                self.score[name] = model.get_score(i)
            self.bytes.append(data)
        # Pieces of equal score have equal rank: the leftmost candidate is next.
        order = {score: n for n, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {name: order[score] for name, score in self.score.items()}
        self.factor = {name: 2 * i + PIECE for name, i in self.ids.items()}
        self.skip_below = int(dropout * 2**32)
        self.seed = seed
        # Symbols are the pieces by their ids, then characters that only stand inside pieces; any other has no number.
        inside = sorted({c for name in self.ids for c in name} - self.ids.keys())
        symbols = self.ids | {c: len(self.bytes) + n for n, c in enumerate(inside)}
        self.nothing = len(self.bytes) + len(inside)
        self.of_point = np.full(0x110000, self.nothing, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.of_point[ord(name)] = i
        self.pairs = _Pairs(symbols, self.ids)
        # By id, and at -1 for no piece.
        self.ranks, self.factors = np.full(len(self.bytes) + 1, NEVER, np.int32), np.zeros(len(self.bytes) + 1, np.uint64)
        for name, i in self.ids.items():
            self.ranks[i], self.factors[i] = self.rank[name], self.factor[name]

    def _skipped(self, key: int, place: int, piece: str) -> bool:
        """Keyed hash of a candidate: the upper half of a product of key, place and piece."""
        x = (key + place * PLACE) * self.factor[piece]
        return (x >> 32) & 0xFFFFFFFF < self.skip_below

    def _base(self, unit: str) -> int:
        return xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"), self.seed)

    def _key(self, unit: str, occurrence: int, document: int = 0) -> int:
        return _spread(self._base(unit) ^ document, occurrence)

    def pieces(self, unit: str, occurrence: int = 0, document: int = 0) -> list[str]:
        """The pieces of a word after the agenda is empty; single characters may be outside the vocabulary.

        The agenda of a short word is a list of the candidates' ranks by place: its least entry is next.
        """
        if len(unit) > SHORT:
            return self._long(unit, occurrence, document)
        symbols, rank = list(unit), self.rank
        agenda = [rank.get(a + b, NEVER) for a, b in zip(unit, unit[1:], strict=False)]
        places = list(range(len(unit)))
        key = None
        while agenda:
            least = min(agenda)
            if least == NEVER:
                break
            i = agenda.index(least)
            pair = symbols[i] + symbols[i + 1]
            if self.skip_below:
                if key is None:
                    key = self._key(unit, occurrence, document)
                if self._skipped(key, places[i], pair):
                    agenda[i] = NEVER
                    continue
            symbols[i] = pair
            del symbols[i + 1], places[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + pair, NEVER)
        return symbols

    def _long(self, unit: str, occurrence: int, document: int = 0) -> list[str]:
        """The same with a heap and linked neighbours, for words of any length."""
        symbols = list(unit)
        last = len(symbols)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        key = self._key(unit, occurrence, document)
        score, agenda = self.score, []
        for i in range(last - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if j >= last or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            if self.skip_below and self._skipped(key, i, pair):
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
                right = pair + symbols[after[i]]
                if right in score:
                    heapq.heappush(agenda, (-score[right], i, right))
            if before[i] >= 0:
                left = symbols[before[i]] + pair
                if left in score:
                    heapq.heappush(agenda, (-score[left], before[i], left))
        return [s for s in symbols if s]

    def unit_ids(self, unit: str, occurrence: int, document: int = 0) -> bytes:
        return np.array(self._numbers(self.pieces(unit, occurrence, document)), "<i4").tobytes()

    def _numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.of_byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str, document: int = 0) -> bytes:
        """The ids of a text as little-endian 32-bit integers; ``document`` is its key."""
        return self.encode_all([text], [document])[0].tobytes()

    def encode_all(self, texts: list[str], documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each end; ``documents`` are their keys."""
        parts, ends, at = [], [0], 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= TOGETHER:
                size += len(texts[to])
                to += 1
            ids, own = self._encode(texts[at:to], documents[at:to])
            parts.append(ids)
            ends += (own + ends[-1]).tolist()
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, "<i4"), np.array(ends)

    def _encode(self, texts: list[str], documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        # The space mark itself, where a text has it, becomes its bytes; as a word it is empty.
        units, sizes = [], []
        for text in texts:
            before = len(units)
            for n, part in enumerate((" " + text).split(SPACE) if text else ()):
                if n:
                    units.append("")
                units += UNIT.findall(part)
            sizes.append(len(units) - before)
        numbers = _Numbers()
        word = np.fromiter(map(numbers.__getitem__, units), np.int64, len(units))
        words = [unit.replace(" ", SPACE) for unit in numbers]
        del units, numbers
        text = np.repeat(np.arange(len(texts)), sizes)
        times = _times_before(text * max(len(words), 1) + word)
        base = np.fromiter(map(self._base, words), np.uint64, len(words))
        keys = _spread_all(base[word] ^ np.array(documents, np.uint64)[text], times)
        size, parts, ids = np.zeros(len(word), np.int64), [], []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths[word], kind="stable")
        by_length = lengths[word[order]]
        mark = np.array([self.of_byte[b] for b in SPACE.encode()], "<i4")
        for length in np.unique(by_length).tolist():
            those = order[slice(*np.searchsorted(by_length, [length, length + 1]))]
            if 0 < length <= SHORT:
                step = max(1, CELLS // length)
                for at in range(0, len(those), step):
                    rows = those[at : at + step]
                    found, many = self._rows(words, word[rows], keys[rows], length)
                    parts.append(rows)
                    ids.append(found)
                    size[rows] = many
            else:
                for row in those.tolist():
                    unit, n = words[word[row]], int(times[row])
                    found = np.frombuffer(self.unit_ids(unit, n, documents[text[row]]), "<i4") if unit else mark
                    parts.append(np.array([row]))
                    ids.append(found)
                    size[row] = len(found)
        stop = np.cumsum(size)
        flat = np.empty(stop[-1] if len(stop) else 0, "<i4")
        for rows, found in zip(parts, ids, strict=True):
            many = size[rows]
            flat[np.repeat(stop[rows] - np.cumsum(many), many) + np.arange(len(found))] = found
        return flat, np.concatenate([[0], stop])[np.cumsum(sizes)]

    def _rows(self, words: list[str], word: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of one length, one row after another, and how many each has; ``word`` are their numbers."""
        distinct, row = np.unique(word, return_inverse=True)
        points = code_points("".join(words[i] for i in distinct.tolist())).reshape(-1, length)
        symbols = self.of_point[points]
        agenda = np.full((len(distinct), length), NEVER, np.int32)
        agenda[:, :-1] = self.ranks[self.pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())].reshape(len(distinct), length - 1)
        symbols, agenda = symbols[row], agenda[row]
        here = np.arange(len(row))
        # A symbol keeps the place of its first character; those merged into another are -1.
        after = np.tile(np.arange(1, length + 1, dtype=np.int8), (len(row), 1))
        before = np.tile(np.arange(-1, length, dtype=np.int8), (len(row), 1))
        adds = np.array(ADDENDS, np.uint64)
        while length > 1 and len(here):
            place = agenda[here].argmin(axis=1)
            least = agenda[here, place]
            some = least < NEVER
            here, place = here[some], place[some]
            if not len(here):
                break
            right = after[here, place].astype(np.int64)
            piece = self.pairs(symbols[here, place], symbols[here, right])
            if self.skip_below:
                x = (keys[here] + adds[place]) * self.factors[piece] >> np.uint64(32)
                skipped = x < np.uint64(self.skip_below)
                agenda[here[skipped], place[skipped]] = NEVER
                merged = np.flatnonzero(~skipped)
                at, place, right, piece = here[merged], place[merged], right[merged], piece[merged]
            else:
                at = here
            symbols[at, place], symbols[at, right], agenda[at, right] = piece, -1, NEVER
            onward = after[at, right].astype(np.int64)
            after[at, place], before[at, onward] = onward, place
            agenda[at, place] = NEVER
            more = np.flatnonzero(onward < length)
            self._look(symbols, agenda, at[more], place[more], onward[more])
            back = before[at, place].astype(np.int64)
            more = np.flatnonzero(back >= 0)
            self._look(symbols, agenda, at[more], back[more], place[more])
        left = symbols >= 0
        unknown = left & (symbols >= len(self.bytes))
        many = left.sum(axis=1)
        found = symbols[left]
        if unknown.any():
            # Characters without a piece become their bytes.
            names = [chr(c) for c in points[row][unknown].tolist()]
            put = [[self.of_byte[b] for b in c.encode("utf-8", "surrogatepass")] for c in names]
            sizes = np.ones(len(found), np.int64)
            odd = np.flatnonzero(unknown[left])
            sizes[odd] = [len(x) for x in put]
            of = np.repeat(np.arange(len(row)), many)
            many = np.bincount(of, sizes, len(row)).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            found = np.repeat(found, sizes)
            spots = np.repeat(starts[odd], sizes[odd]) + np.concatenate([np.arange(len(x)) for x in put])
            found[spots] = [i for x in put for i in x]
        return found, many

    def _look(self, symbols: np.ndarray, agenda: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """The candidate of two neighbours enters the agenda."""
        agenda[row, left] = self.ranks[self.pairs(symbols[row, left], symbols[row, right])]

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded; the space in front is the encoder's own."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "surrogatepass")


_CODECS: dict[tuple, Codec] = {}


def codec(*key) -> Codec:
    """The codec of this worker process."""
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids and text_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                names = part.column("doc_id").to_pylist()
                flat, ends = own.encode_all(texts, [document_key(d, t) for d, t in zip(names, texts, strict=True)])
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array(digests, pa.string()),
                    ],
                    ["doc_id", "ids", "text_sha256"],
                )

    return texts.mapInArrow(encode, f"doc_id {kind}, ids array<int>, text_sha256 string")


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``rows`` with the text of its ``ids``."""
    names = rows.columns
    at = names.index("ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, 0.0, 0)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                found = [own.decode(x.values.to_numpy()) if x.is_valid and len(x) else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(decode, f"{kinds}, decoded string")
