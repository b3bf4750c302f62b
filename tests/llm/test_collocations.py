import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tabaudit.llm import collocations
from tests.llm.conftest import EDGES, LONG


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for row in rows:
        text, lang = row[1], (row[2] if len(row) > 2 else "en")
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, 5):
                    if i + m <= len(w):
                        f[lang, tuple(w[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) >= 2}
    out = []
    for (lang, p), a in cands.items():
        cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        k = cut[1]
        inside = any(
            len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (lq, q), b in cands.items()
            if lq == lang
        )
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], cut[0]))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def run(documents, rows, parts=3, top=2000, limit_rows=collocations.BROADCAST_ROWS):
    return sorted(tuple(r) for r in collocations.collocations(documents(rows, parts), top, limit_rows).collect())


def test_three_way_counts_over_ranges():
    rng = np.random.default_rng(7)
    rows = rng.integers(-1, 4, size=(5, 4000))
    rows[0] = rng.integers(0, 2, 4000)
    rows[1] = rng.integers(0, 5, 4000)
    for d in (2, 3):
        rows[d + 1][rows[d] == -1] = -1
    keys = np.unique(rows, axis=1)
    weights = rng.integers(1, 9, keys.shape[1])
    truth = Counter()
    for j in range(keys.shape[1]):
        for d in range(1, 5):
            if keys[d, j] < 0:
                break
            truth[tuple(keys[: d + 1, j])] += int(weights[j])
    order = np.lexsort(keys[::-1])
    got = Counter()
    for part in np.array_split(order, 7):
        el, ln, ct, edge = collocations.three_way_counts(keys[:, part], weights[part], 30)
        for e, d, c in zip(el, ln, ct):
            got[tuple(keys[: d + 1, part[e]])] += int(c)
    assert {k: v for k, v in got.items() if v >= 30} == {k: v for k, v in truth.items() if v >= 30}


def test_matches_brute_force(documents):
    base = "the old mill stands by the river. the old mill stands, the red barn; a quiet lane\n"
    rows = [(i, base * (1 + i % 4) + ("The Old mill " if i % 3 else ""), ["en", None, "de"][i % 3]) for i in range(60)]
    rows += EDGES + [(70, "a\tb a b a b. " * 40, "en"), (70, "a\tb a b a b. " * 40, "en")]
    assert run(documents, rows) == brute(rows)
    assert run(documents, rows, parts=1, top=3) == brute(rows, top=3)


def test_hot_passage_and_long_text(documents):
    passage = "one quiet passage that many texts share and repeat. "
    rows = [(i, passage * 3 + f"own{i} words", "en") for i in range(200)] + [(500, LONG, "en"), (501, LONG, "fr")]
    assert run(documents, rows, parts=5) == brute(rows)
    assert run(documents, rows, parts=4, limit_rows=0) == brute(rows)


ODD = ["a\x00 b\x00\x01 a\x00", "ÄB äB\u00a0c\u3000d 日本. 日本", "\ta  b\r\x0bc \x0c\x1f", "", "\n..", "A"]
ODD += ["b" * 5000 + " b"]


def test_odd_words_and_languages(documents):
    rows = [(i, text, lang) for i in range(31) for text in ODD for lang in ("", None, "und", "é")]
    assert run(documents, rows) == brute(rows)
    assert run(documents, rows, parts=2, limit_rows=0) == brute(rows)


def test_slices_hold_every_word(monkeypatch):
    texts = [t + "\n" for t in ODD + ["one two. three", LONG[:3000], "x y"] * 3]
    langs = [["en", "", "de"][i % 3] for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "text"])
    truth = []
    for lang, text in zip(langs, texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            truth += [(lang, w, i + 1 < len(words)) for i, w in enumerate(words)]
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(collocations, "SLICE_BYTES", size)
        for batches in ([batch], [batch.slice(0, 5), batch.slice(5)]):
            got, hashes = [], {}
            for s in collocations._slices(iter(batches)):
                words = s.words.take(pa.array(s.code)).to_pylist()
                spoken = s.langs.take(pa.array(s.lang)).to_pylist()
                got += zip(spoken, words, s.same.tolist())
                for i, key in enumerate(zip(spoken, words)):
                    assert hashes.setdefault(key, s.single[i]) == s.single[i]
                    if s.same[i]:
                        assert hashes.setdefault((*key, words[i + 1]), s.pair[i]) == s.pair[i]
            assert got == truth and len(set(hashes.values())) == len(hashes)


def test_heads_end_before_infrequent_pairs_and_triples(documents):
    ends = ["a b c d"] * 5 + ["u v w"] * 35 + [f"only{i}" for i in range(20)]
    rows = [(i, "a b, b c, c d. " + end, "en") for i, end in enumerate(ends)]
    texts = collocations._texts(documents(rows))
    heads = collocations.suffixes(texts, collocations.frequent_hashes(texts)).collect()
    # Before, "a b c d" was a head of four words, because its pairs are frequent.
    got = {tuple(w for w in (r.w1, r.w2, r.w3, r.w4) if w is not None): r.c for r in heads}
    assert got == {
        ("a", "b"): 65, ("b", "c"): 65, ("c", "d"): 65, ("b",): 60, ("c",): 60, ("d",): 65,
        ("u", "v", "w"): 35, ("v", "w"): 35, ("w",): 35, (): 20,
    }


def test_empty(documents, no_documents):
    assert collocations.collocations(no_documents).count() == 0
    assert run(documents, [(1, None, None), (2, "", "en")]) == []


def test_sql_matches_query(spark):
    from tests.compare import _rows, connect
    from tabaudit.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    df = QUERIES["op12_collocations"](spark, folder)
    cur = connect(folder).execute(SQL["op12_collocations"])
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine == _rows([d[0] for d in cur.description], cur.fetchall()) and mine[1]
