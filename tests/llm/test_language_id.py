from collections import Counter

import numpy as np

from tabaudit.llm import language_id
from tabaudit.llm.language_id import BEGIN, UNKNOWN, Model

DATA = "/root/testdata/sf0.001"


def model():
    m = Model(["a", "b"], language_id._start(2), np.log([0.5, 0.5]))
    m.table = np.random.default_rng(3).random(m.table.shape) / 500
    return m


def by_recursion(word, table):
    """The sum over all segmentations, one by one."""
    number = {p: i for i, p in enumerate(language_id.pieces())}
    word = BEGIN + word

    def rest(i):
        if i == len(word):
            return np.ones(2)
        total = np.zeros(2)
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in number:
                total += table[number[word[i:j]]] * rest(j)
            elif j == i + 1:
                total += UNKNOWN * rest(j)
        return total

    return rest(0)


def test_forward_sums_all_segmentations():
    m, words = model(), ["the", "élleç", "theation", "x", "хлеб", "日本", "ꙮ"]
    assert np.allclose(np.exp(m.log_probabilities(words)), [by_recursion(w, m.table) for w in words])


def test_expected_uses_are_the_gradient():
    m, words = model(), ["the", "then", "other", "bathe"]
    piece = language_id.pieces().index("the")
    uses = m.expected(words, np.ones((4, 2)))[piece]
    before = m.log_probabilities(words).sum(axis=0)
    m.table[piece] *= 1 + 1e-6
    assert np.allclose(uses, (m.log_probabilities(words).sum(axis=0) - before) / 1e-6, atol=1e-4)


def test_words():
    assert language_id.words_of("Der Hund, der\n2 Hunde_x") == {"der": 2, "hund": 1, "hunde": 1, "x": 1}
    assert sum(language_id.words_of("a" * 150).values()) == 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 200 and 10 < len(held) < 80
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_edges(edges, no_documents):
    found = language_id.identify(edges).collect()
    assert len(found) == edges.count()
    assert sorted(r.lang_pred for r in found if r.doc_id in (3, 4, 6)) == ["und"] * 3
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 5)} == {"en"}
    kept = language_id.keep_identified(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 7, None}
    assert language_id.identify(no_documents).count() == 0
    assert language_id.keep_identified(no_documents).count() == 0


def test_nothing_to_learn(documents):
    docs = documents([(1, "a text", None), (2, None, "en")])
    assert {r.lang_pred for r in language_id.identify(docs).collect()} == {"und"}


def test_counts_of_words_are_arrays():
    """What a task holds for a word is its name, a number and a row of an array, whatever the number of languages."""
    counts = language_id.WordCounts(4)
    for n in range(30_000):
        counts.add(Counter({f"w{n}": n, "same": 2}), n % 4)
    parts = [(w, r.copy()) for w, r in counts.parts(7_000)]
    words, rows = [w for p in parts for w in p[0]], np.concatenate([p[1] for p in parts])
    assert [len(p[0]) for p in parts] == [7_000] * 4 + [2_001] and words[:2] == ["w0", "same"]
    assert rows[1].tolist() == [15_000] * 4 and rows[words.index("w9")].tolist() == [0, 9, 0, 0]
    counts.clear()
    assert not counts.numbers and not counts.rows.any()
