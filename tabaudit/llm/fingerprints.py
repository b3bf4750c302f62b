"""Document fingerprints by content-defined chunking.

The UTF-8 bytes of a text are cut where a gear hash of the last 32 bytes has leading zeros: seven of them before the
usual length of a chunk, four after it (normalised chunking), never before ``LEAST`` bytes and always at ``MOST``. A cut
depends on the bytes near it only, so chunks away from an edit stay the same when text shifts. A fingerprint is the
set of chunk digests, each with its length; the likeness of one text to another is the share of its chunks' bytes
that the other contains. Equal texts have equal fingerprints; an empty text has the empty one, which is like itself
only.

``neighbours`` compares every document with the next one by falling ``doc_id`` and with an edited text of its own.
Documents are dealt over ranges of ``doc_id``; the first document of a range is also sent to the range before it, as
the neighbour of that one's last. Each range is sorted and read as a stream, two texts at a time.

A null text counts as empty. A null ``doc_id`` is smaller than any other; documents of equal id stand by text. Rows
that repeat both id and text are one document. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import mixed, whole_text

LEAST, USUAL, MOST = 16, 48, 256
HARD, EASY = 7, 4
DOCS_A_RANGE = 2048
RANGES = 4096

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ENTRY = np.dtype([("digest", ">u4"), ("size", ">u2")])


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes up to each place, summed in five doublings."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        shifted = h[:-shift] << np.uint32(shift)
        h = h.copy()
        h[shift:] += shifted
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY)))
    hard = easy[h[easy] < np.uint32(1 << (32 - HARD))].tolist()
    easy, out, start = easy.tolist(), [], 0
    while n - start > LEAST:
        usual, most = start + USUAL, min(start + MOST, n)
        at = bisect_left(hard, start + LEAST)
        end = hard[at] + 1 if at < len(hard) and hard[at] < usual else 0
        if not end:
            at = bisect_left(easy, usual)
            end = easy[at] + 1 if at < len(easy) else most
        start = min(end, most)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunk_set(text: str) -> dict[int, int]:
    """Digest and length of every different chunk."""
    data, start, out = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in cuts(data):
        out[xxhash.xxh32_intdigest(data[start:end])] = end - start
        start = end
    return out


def fingerprint(chunks: dict[int, int]) -> str:
    """The sorted set as text: four bytes of digest and two of length per chunk, in base 64."""
    entries = np.array(sorted(chunks.items()), dtype=_ENTRY)
    return base64.b64encode(entries.tobytes()).decode()


def chunks_of(written: str) -> dict[int, int]:
    """The set that a fingerprint states."""
    entries = np.frombuffer(base64.b64decode(written), _ENTRY)
    return dict(zip(entries["digest"].tolist(), entries["size"].tolist(), strict=True))


def likeness(one: dict[int, int], other: dict[int, int]) -> float:
    """The share of the bytes of ``one``'s chunks that ``other`` contains."""
    if not one:
        return 0.0 if other else 1.0
    return sum(one[d] for d in one.keys() & other.keys()) / sum(one.values())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(chunk_set(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    texts = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"))
    return texts.mapInArrow(read, f"doc_id {kind}, fingerprint string")


def _ranges(docs: DataFrame) -> tuple[list, object]:
    """The largest doc_id of every range but the last, and the largest of all; a few thousand values at most."""
    n, largest = docs.agg(F.count("*"), F.max("doc_id")).first()
    several = min(RANGES, n // DOCS_A_RANGE + 1)
    if several == 1 or largest is None:
        return [], largest
    shares = [i / several for i in range(1, several)]
    splits = docs.agg(F.percentile_approx("doc_id", shares, 10 * RANGES)).first()[0]
    return sorted(set(splits) - {largest}), largest


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    ``doc_id`` must be a number: ranges are taken from its quantiles.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"))
    splits, largest = _ranges(texts)
    # Range i holds the ids above split i - 1 up to split i, so that its first document by falling id is split i.
    bounds = F.array(*[F.lit(s) for s in splits]) if splits else F.expr("CAST(array() AS array<bigint>)")
    own = F.size(F.filter(bounds, lambda s: s < F.col("doc_id")))
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(own)
    before = F.when(F.col("doc_id").eqNullSafe(F.lit(largest)), 0).when(
        F.array_contains(bounds, F.col("doc_id")), own + 1
    )
    dealt = texts.withColumn("to", F.explode(F.array_compact(F.array(own, -1 - before))))
    dealt = dealt.select(
        F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("range"),
        (F.col("to") < 0).alias("guest"),
        "doc_id",
        "text",
    )
    order = ["range", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    sorted_ranges = dealt.repartition("range").sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for place, guest, doc_id, text in rows:
                if held and held[:4] == (place, guest, doc_id, text):
                    continue
                # The first guest ends a range; others of the same id are further rows of its own range.
                if held and held[0] == place and held[1]:
                    continue
                new = (place, guest, doc_id, text, chunk_set(text))
                if held and held[0] == place:
                    changed = edited(held[3], text)
                    after = chunk_set(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append(
                        (
                            held[2],
                            len(held[3]),
                            digest,
                            fingerprint(held[4]),
                            fingerprint(after),
                            likeness(held[4], after),
                            likeness(held[4], new[4]),
                        )
                    )
                held = new
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return sorted_ranges.mapInArrow(
        compare,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
