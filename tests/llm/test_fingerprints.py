import hashlib
import random

from tabaudit.llm import fingerprints as fp

DATA = "/root/testdata/sf0.001"


def brute(rows):
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = fp.edited(text, following)
        one, two, three = map(fp.chunk_set, (text, changed, following))
        out[i, text] = (
            len(text),
            hashlib.sha256(changed.encode()).hexdigest(),
            fp.fingerprint(one),
            fp.fingerprint(two),
            fp.likeness(one, two),
            fp.likeness(one, three),
        )
    return out


def same(found, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple(r)[1:]) for r in found)
    return got == sorted((i is None, i or 0, v) for (i, _), v in brute(rows).items())


def test_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "DOCS_A_RANGE", 7)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert same(fp.neighbours(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_ties_and_nulls(edges, documents, no_documents, monkeypatch):
    assert same(fp.neighbours(edges).collect(), [(r.doc_id, r.text) for r in edges.collect()])
    monkeypatch.setattr(fp, "DOCS_A_RANGE", 2)
    rows = [(i % 9, f"text {i % 13} " * 5) for i in range(60)] + [(None, "a"), (None, None)]
    assert same(fp.neighbours(documents(rows)).collect(), rows)
    assert same(fp.neighbours(documents([(4, "alone")])).collect(), [(4, "alone")])
    assert same(fp.neighbours(documents([(None, "alone")])).collect(), [(None, "alone")])
    assert fp.neighbours(no_documents).count() == 0 and fp.fingerprints(no_documents).count() == 0


def test_gear_is_the_rolling_hash():
    data = bytes(random.Random(1).choices(range(256), k=300))
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(fp._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    import numpy as np

    assert fp.gear(np.frombuffer(data, np.uint8)).tolist() == out


def test_cuts_resist_shifts():
    text = " ".join(random.Random(2).choices([f"word{i}" for i in range(900)], k=800))
    assert fp.likeness(fp.chunk_set(text), fp.chunk_set("put in front " + text)) > 0.9
    ends = fp.cuts(text.encode())
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(text) and max(sizes) <= fp.MOST and min(sizes[:-1]) >= fp.LEAST


def test_fingerprint_states_its_set(edges):
    chunks = fp.chunk_set("some text that is cut " * 40 + "end")
    assert fp.chunks_of(fp.fingerprint(chunks)) == chunks
    assert fp.likeness({}, {}) == 1 and fp.likeness({}, chunks) == 0
    found = [r.fingerprint for r in fp.fingerprints(edges).collect() if r.doc_id == 2]
    assert len(found) == 2 and found[0] == found[1]
