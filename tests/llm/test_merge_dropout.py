import tracemalloc

import numpy as np
import public_tokenizers
import sentencepiece

from tabaudit.llm import merge_dropout
from tabaudit.llm.merge_dropout import Codec
from tests.llm.conftest import LONG

TEXTS = ["  Hello  wörld\n\tx", "日本語 хлеб 🎉", " ", "    ", "\0a", "x" * 300, "(" * 50 + " it's", "", "Plain words here."]


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<i4")


def test_without_dropout_it_is_the_vocabularys_encoder(spark):
    own = Codec(dropout=0.0)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in [*TEXTS, *docs]:
        assert ids(own, text).tolist() == model.encode(text), text[:80]


def test_lossless_and_varied():
    one, two, again = Codec(seed=1), Codec(seed=2), Codec(seed=1)
    for text in [*TEXTS, "a  ▁ b▁", "▁", "▁▁ x", LONG]:
        assert one.decode(ids(one, text)) == text if text else not len(ids(one, text))
        assert ids(one, text).tolist() == ids(again, text).tolist()
    assert ids(one, LONG).tolist() != ids(two, LONG).tolist()
    assert len({tuple(one.pieces("▁international", k)) for k in range(40)}) > 2


def test_varied_over_documents_and_occurrences(documents):
    """Equal texts of many documents, and a word that stands many times in one, are not cut to a few forms."""
    rows = merge_dropout.encoded(documents([(i, "international") for i in range(200)])).collect()
    assert len({tuple(r.ids) for r in rows}) > 10
    again = merge_dropout.encoded(documents([(i, "international") for i in range(200)], parts=5)).collect()
    assert {r.doc_id: r.ids for r in rows} == {r.doc_id: r.ids for r in again}
    own, times = Codec(), 200
    forms = [own.unit_ids("▁international", k, 5) for k in range(times)]
    assert own.encode(" ".join(["international"] * times), 5) == b"".join(forms) and len(set(forms)) > 10


def test_list_and_heap_agendas_agree():
    own = Codec(dropout=0.3)
    for word in {w for t in TEXTS for w in t.replace(" ", "▁▁").split("\n")} | {"▁unbelievably", "aaaaaaaaaa"}:
        for k in range(5):
            assert own.pieces(word[:48], k) == own._long(word[:48], k)


def test_edges(edges, no_documents):
    rows = merge_dropout.decoded(merge_dropout.encoded(edges)).collect()
    got = sorted(((r.doc_id is None, r.doc_id), r.decoded) for r in rows)
    assert got == sorted(((r.doc_id is None, r.doc_id), r.text or "") for r in edges.collect())
    assert merge_dropout.decoded(merge_dropout.encoded(no_documents)).count() == 0


def test_memory_does_not_grow_with_the_words():
    own = Codec()
    own.encode_all([" ".join(f"x{i}y" for i in range(2000))], [1])
    tracemalloc.start()
    for part in range(5):
        own.encode_all([" ".join(f"a{i}b" for i in range(part * 20_000, (part + 1) * 20_000))], [part])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1_000_000


def test_documents_together_are_as_word_by_word():
    own = Codec(dropout=0.3)
    texts = [*TEXTS, "a  ▁ b▁", "▁▁ x", "ﬁ ͸é " * 7, "international " * 20, "a" * 47 + " " + "b" * 48, LONG[:3000]]
    flat, ends = own.encode_all(texts, list(range(len(texts))))
    for n, text in enumerate(texts):
        times, out = {}, b""
        for k, part in enumerate((" " + text).split("▁") if text else ()):
            out += np.array([own.of_byte[b] for b in "▁".encode()], "<i4").tobytes() if k else b""
            for unit in merge_dropout.UNIT.findall(part):
                unit = unit.replace(" ", "▁")
                out += own.unit_ids(unit, times.get(unit, 0), n)
                times[unit] = times.get(unit, 0) + 1
        assert flat[ends[n] : ends[n + 1]].tobytes() == out, text[:80]
