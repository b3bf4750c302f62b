import pytest

from tabaudit.llm import warc

NASTY = [
    "WARC/1.1\r\n",
    "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nx" * 40,
    "\r\n" * 20_000,
    "é🎉" * 9000,
    "0\r\n\r\n",
    "<p>plain</p>",
    "<p>plain</p>",
    "",
    None,
    "W" * 16384,
    "\n",
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, bytes int").repartition(3)


def brute(rows):
    first, out = {}, set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        payload = (h or "").encode()
        response = first[h or ""] == i
        refers = None if response else first[h or ""]
        out.add((i, len(payload), warc.sha1_base32(payload), "response" if response else "revisit", refers))
    return out


ROWS = [(i, f"http://x/{i}\n" if i % 2 else None, h) for i, h in enumerate(NASTY)] + [(None, None, "n"), (None, None, "m"), (5, None, NASTY[5])]


def test_round_trip(spark):
    found = [tuple(r) for r in warc.round_trip(pages(spark, ROWS), segment=1000).collect()]
    assert set(found) == brute(ROWS) and len(found) == len(set(found))


def test_whole_files(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS), f"{tmp_path}/w", segment=1000, compression="none")
    assert {tuple(r) for r in warc.read_archives(spark, f"{tmp_path}/w", whole_files=True).collect()} == brute(ROWS)


def test_small_payloads_are_responses(spark):
    rows = [(1, None, "ab"), (2, None, "ab"), (3, None, "long enough"), (4, None, "long enough")]
    found = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, rows), least=5).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_missing_segment_is_an_error(spark):
    records = [
        ("o", 1, None, "response", 1, None, "D", None, b"abc"),
        ("o", 3, 9, "response", 1, None, "D", None, b"def"),
    ]
    df = spark.createDataFrame(records, warc.RECORD.format(page="long"))
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassembled(df).collect()


@pytest.mark.parametrize("html", [h or "" for h in NASTY])
def test_framing(html):
    payload = html.encode()
    body = warc.chunked(payload, 100)
    assert warc.unchunked(body) == payload and warc.BEGIN not in body
    assert b"".join(warc.segments(body, 7)) == body and warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, ROWS).filter("false")).count() == 0
