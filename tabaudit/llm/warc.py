"""WARC archives: pages are written as records and read back, with segments reassembled.

Writing. Every page is a record whose block is an HTTP response with a chunked body. Of pages with equal payloads the
one with the smallest ``page_id`` is a ``response``, the others are ``revisit`` records without a body that refer to
it; payloads of fewer than ``least`` bytes are always responses. Blocks above ``segment`` bytes are cut: the first
record has segment number 1, ``continuation`` records follow, the last of them states the total length.
Archives are files of whole records, written by Spark's text writer with the records' own end as separator, so they
go to any file system and survive lost executors.

Reading. Records are split at the line that begins the next one, which needs no whole file in memory; the stated
length of each block is verified. ``whole_files=True`` reads archives of other writers whose blocks may hold that
line: it walks each file by the stated lengths. Segments are grouped by the origin's identifier, ordered by number
and verified to be complete; then the chunked framing is decoded and the digest compared. A record that fails any of
these raises ``ValueError``: nothing is dropped.

A null html is an empty payload. A null ``page_id`` is larger than any other and equal to itself. Rows that repeat
page and payload are one record: both are written, one is returned. A null url is left out of the record. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import shared_folder, stored

# Fixed values of the format.
BEGIN = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
# Where records are split, and what of a record's end is left of it. One break only: Hadoop's reader loses its place
# in a run of several.
SPLIT = "\nWARC/1.1\r\n"
SEPARATED = b"\r\n\r"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = 4096
SEGMENT = 16384
DATE = "2000-01-01T00:00:00Z"

RECORD = (
    "origin string, number int, total long, type string, page_id {page}, refers_to {page}, digest string, "
    "bytes long, block binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    """The chunked framing of a payload. A chunk ends inside every text that could be read as the begin of a record."""
    inside = [m.start() + 1 for m in re.finditer(re.escape(BEGIN), payload)]
    cuts = sorted({*range(0, len(payload), chunk), *inside, len(payload)})
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; sizes may carry extensions, trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(body[at : at + size])
        at += size + 2


def segments(block: bytes, size: int = SEGMENT) -> list[bytes]:
    """The block in pieces of at most ``size`` bytes."""
    return [block[at : at + size] for at in range(0, len(block), size)]


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line breaks that end it."""
    lines = [f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return BEGIN + "".join(lines).encode() + b"\r\n" + block


def _urn(page_id: object, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _one_line(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s", "%20", text)


def page_records(
    page_id: object, url: str | None, payload: bytes, keep: object, response: bool, segment: int, date: str
) -> list[bytes]:
    digest = sha1_base32(payload)
    name = _urn(page_id, digest)
    common = [("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = ("Content-Type", "application/http; msgtype=response")
    if not response:
        refers = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _urn(keep, digest))]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *refers, http], HTTP)]
    parts = segments(HTTP + chunked(payload), segment)
    number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, number, http], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = sum(map(len, parts)) if n == len(parts) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), *common]
        own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        out.append(record(own, part))
    return out


def write_archives(
    pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, date: str = DATE, compression: str = "gzip"
) -> None:
    """Write a record (or several segments) for every row of ``pages`` (page_id, url, html).

    Each task writes one file, compressed as usual for archives (``none`` leaves them plain).
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        pages["page_id"].alias("page_id"), pages["url"].alias("url"), html.alias("payload"), F.sha1(html).alias("sha1")
    )
    # The smallest page of each payload, written first so that a hot payload can be split in the join.
    first = stored(rows.groupBy("sha1").agg(F.min("page_id").alias("keep")), "warc-first")
    rows = rows.join(first, "sha1").select(
        "page_id",
        "url",
        "payload",
        "keep",
        (F.col("page_id").eqNullSafe(F.col("keep")) | (F.octet_length("payload") < least)).alias("response"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [
                    value
                    for row in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True)
                    for value in page_records(*row, segment, date)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    values = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.options(lineSep=END.decode(), compression=compression).text(path)


def parsed(data: bytes) -> dict:
    """The fields of one record, its block cut to the stated length."""
    head, _, rest = data.removeprefix(BEGIN).partition(END)
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"])
    if len(rest) < length or rest[length:] not in (b"", SEPARATED, END):
        raise ValueError(f"record {fields.get('warc-record-id')}: the block has not the stated length")
    fields["block"] = rest[:length]
    return fields


def _walked(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        head = data.index(END, at)
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", data[at:head])[1])
        stop = head + len(END) + length
        yield data[at:stop]
        at = stop + len(END)


def _number(urn: str | None, whole: bool) -> object:
    if urn is None:
        return None
    text = urn.strip("<>").removeprefix("urn:page:").split(":")[0]
    return None if text == "null" else int(text) if whole else text


def payload_of(block: bytes, digest: str) -> tuple[int, str]:
    payload = unchunked(block.partition(END)[2])
    found = sha1_base32(payload)
    if found != digest:
        raise ValueError(f"the payload's digest is {found}, not {digest}")
    return len(payload), found


def _row(fields: dict, whole: bool) -> tuple:
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    n, block = None, fields["block"]
    if kind == "revisit" or number is None:
        n, block = None if kind == "revisit" else payload_of(block, digest)[0], None
    return (
        origin,
        number and int(number),
        total and int(total),
        "response" if kind == "continuation" else kind,
        _number(origin, whole),
        _number(fields.get("warc-refers-to"), whole),
        digest,
        n,
        block,
    )


def read_records(spark: SparkSession, path: str, page_type: str = "long", whole_files: bool = False) -> DataFrame:
    """Every record of the archives: origin, segment number, total, type, page_id, refers_to, digest, bytes, block."""
    if whole_files:
        data = spark.read.format("binaryFile").load(path).select(F.col("content").alias("value"))
    else:
        data = spark.read.option("lineSep", SPLIT).text(path)
        data = data.select(F.col("value").cast("binary").alias("value")).filter(F.octet_length("value") > 0)
    whole = page_type != "string"
    schema = RECORD.format(page=page_type)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                values = batch.column(0).slice(at, 512).to_pylist()
                records = (r for v in values for r in (_walked(v) if whole_files else [v]))
                rows = [_row(parsed(r), whole) for r in records]
                columns = list(zip(*rows, strict=True)) or [()] * 9
                page = pa.int64() if whole else pa.string()
                types = [pa.string(), pa.int32(), pa.int64(), pa.string(), page, page, pa.string(), pa.int64(), pa.binary()]
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return data.mapInArrow(parse, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """origin, page_id, digest and bytes of every segmented record, from all its segments."""
    part = F.struct("number", "total", "block")
    pieces = records.groupBy("origin", "page_id", "digest").agg(
        F.array_sort(F.array_distinct(F.collect_list(part))).alias("parts")
    )
    page = records.schema["page_id"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for origin, digest, parts in zip(
                *(batch.column(name).to_pylist() for name in ("origin", "digest", "parts")), strict=True
            ):
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"record {origin}: segments are missing or have not the total length")
                sizes.append(payload_of(block, digest)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("origin"), batch.column("page_id"), batch.column("digest"), pa.array(sizes, pa.int64())],
                ["origin", "page_id", "digest", "bytes"],
            )

    return pieces.mapInArrow(join, f"origin string, page_id {page}, digest string, bytes long")


def read_archives(spark: SparkSession, path: str, page_type: str = "long", whole_files: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record."""
    records = stored(read_records(spark, path, page_type, whole_files), "warc-records")
    whole = records.filter("number IS NULL AND type = 'response'").select("origin", "page_id", "digest", "bytes")
    responses = whole.distinct().unionByName(reassembled(records.filter("number IS NOT NULL")))
    responses = stored(responses, "warc-responses")
    revisits = records.filter("type = 'revisit'").select("origin", "page_id", "digest", "refers_to").distinct()
    # A revisit has the payload of the record that it refers to.
    sized = responses.select(F.col("page_id").alias("keep"), F.col("digest").alias("of"), "bytes")
    met = (F.col("digest") == F.col("of")) & F.col("refers_to").eqNullSafe(F.col("keep"))
    revisits = revisits.join(sized, met, "left").select(
        "page_id", "bytes", "digest", F.lit("revisit").alias("record_type"), "refers_to"
    )
    nobody = F.lit(None).cast(page_type).alias("refers_to")
    rows = responses.select("page_id", "bytes", "digest", F.lit("response").alias("record_type"), nobody)
    return rows.unionByName(revisits).select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read these back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path, least, segment)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(pages.sparkSession, path, "string" if kind == "string" else "long")
