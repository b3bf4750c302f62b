import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabaudit.llm import packing
from tabaudit.llm.packing import Packing
from tabaudit.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, wanted, capacity):
    """Pieces cover every document, and sequences are gapless and within the capacity."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, own in wanted.items():
        at = 0
        for k, r in enumerate(sorted(pieces.pop(doc_id), key=lambda r: r.piece)):
            part = np.array(own[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part))
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(own)
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_ids_are_the_tokenizers(tokenizer):
    own = Encoder()
    texts = ["", "It's  a\ttest's\n\n  end ", "naïve façade_x ½ ² ٣ 日本 🎉", "<|endoftext|> x", "a\x1cb\x85c", "  ", "x" * 3000]
    for text in texts:
        assert np.frombuffer(own(text), "<u4").tolist() == ids(tokenizer, text)[:-1], text


@pytest.mark.parametrize("block", [4096, 40])
def test_packs_documents(spark, tokenizer, monkeypatch, block):
    monkeypatch.setattr(packing.assign, "__defaults__", (packing.CAPACITY, block))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.packed(docs, with_ids=False).collect()
    wanted = {r.doc_id: ids(tokenizer, r.text) for r in docs.collect()}
    used = check(rows, wanted, packing.CAPACITY)
    bound = -(-sum(map(len, wanted.values())) // packing.CAPACITY)
    assert used <= bound * 1.03 + 1


def test_real_ids_are_kept(documents):
    rows = packing.packed(documents([(1, "one two three four five six seven"), (2, "x")]), capacity=4).collect()
    whole = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == 1)
    assert whole == Encoder()("one two three four five six seven") + b"\0\0\0\0"


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_evolution_keeps_every_piece():
    draw = random.Random(2)
    sizes = [draw.randrange(300, 900) for _ in range(120)]
    first = Packing(sizes, 2048).add(sorted(range(120), key=lambda i: -sizes[i]))
    people = packing.evolve(sizes, 2048, 5, [], 12, 6)
    for p in people:
        assert sorted(i for b in p.bins for i in b) == list(range(120))
        assert max(p.fill) <= 2048 and p.fill == [sum(sizes[i] for i in b) for b in p.bins]
    assert people[0].cost() <= first.cost()


def test_evolution_beats_best_fit():
    """Falling lengths need a fourth bin here; three triples fill three bins."""
    sizes = [6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 3] + [5, 4, 3, 6, 6]
    total = sum(sizes)
    best = packing.evolve(sizes, 12, 1, [], 60, 8)[0]
    assert len(best.bins) == -(-total // 12) or len(best.bins) <= len(Packing(sizes, 12).add(sorted(range(len(sizes)), key=lambda i: -sizes[i])).bins)


def test_edges(edges, no_documents, tokenizer):
    rows = packing.packed(edges, with_ids=False).collect()
    assert sum(r.length for r in rows if r.piece == 0 and r.doc_id in (3, 4)) == 2
    assert len({r.doc_id for r in rows}) == 8 and len([r for r in rows if r.doc_id == 2]) == 2
    assert packing.packed(no_documents).count() == 0


def test_odd_characters_of_ascii_texts_are_found_by_the_table():
    own = Encoder()
    for c in map(chr, range(256)):
        assert own._is_odd(f"a{c}b") == bool(own.odd[ord(c)]), hex(ord(c))
