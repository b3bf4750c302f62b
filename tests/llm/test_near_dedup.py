import random
from itertools import combinations

import numpy as np
import pytest

from tabaudit.llm import near_dedup
from tabaudit.llm.common import word_hashes

DRAW = random.Random(5)
WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    return near_dedup.labelled_shingles(word_hashes((text or "").lower()).astype(np.uint32).astype(np.uint64))


def brute(rows, least=0.8):
    """Classes by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    marks = [shingles(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        if near_dedup.similarity(marks[i], marks[j], least) >= least:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        words[DRAW.randrange(len(words))] = DRAW.choice(WORDS)
    return " ".join(words)


def corpus():
    rows = []
    for _ in range(25):
        base = " ".join(DRAW.choices(WORDS, k=DRAW.randrange(60, 250)))
        rows += [base, edited(base, 1), edited(base, 2), edited(base, 12), base.upper() + "!"]
    shared = " ".join(DRAW.choices(WORDS, k=60))
    rows += [f"{' '.join(DRAW.choices(WORDS, k=60))} {shared}" for _ in range(30)]
    hot = " ".join(DRAW.choices(WORDS, k=200))
    rows += [edited(hot, DRAW.randrange(6)) for _ in range(60)]
    return list(enumerate([*rows, "", None, "one two", "one two", "three"]))


@pytest.mark.parametrize("paired", [32, 4])
def test_classes_match_brute_force(documents, monkeypatch, paired):
    """With buckets of four nodes at most, most groups take the split and the centres."""
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    rows = corpus()
    found = near_dedup.near_classes(documents(rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(zip((i for i, _ in rows), brute(rows), strict=True))
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.class_id for r in found})


def templated():
    """Texts of one template, just too different to be links; the partner of each is a copy with three edits."""
    draw = random.Random(1)
    template, rows = draw.choices(WORDS, k=120), []
    for _ in range(300):
        own = template[:60] + draw.choices(WORDS, k=13) + template[60:]
        partner = list(own)
        for _ in range(3):
            partner[draw.randrange(len(partner))] = draw.choice(WORDS)
        rows += [" ".join(own), " ".join(partner)]
    return list(enumerate(rows))


def test_partners_within_a_template(documents, monkeypatch):
    """The only similar text of each lies in a large group that no centre connects."""
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    rows = templated()
    found = near_dedup.near_classes(documents(rows)).collect()
    wanted = brute(rows)
    assert len(set(wanted)) > 300
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(wanted))


@pytest.mark.parametrize("slots", [1, 64])
def test_shingles_may_share_a_count(documents, monkeypatch, slots):
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    monkeypatch.setattr(near_dedup, "SLOTS", slots)
    rows = templated()[:200]
    found = near_dedup.near_classes(documents(rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(brute(rows)))


def test_shingles_of_large_groups_are_not_joined(documents):
    """Each text gives its rarest shingles only, from the task that reads it."""
    rows = near_dedup.sketched(documents(templated()[:100]))
    prefixes = near_dedup._prefixes(rows.select(rows["row"].alias("node"), "words"), 0.8)
    plan = prefixes._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    sizes = {r.node: r.size for r in prefixes.collect()}
    assert sizes and prefixes.count() <= sum(0.2 * n + 2 for n in sizes.values())


def test_edited_copies_without_their_base(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    draw = random.Random(3)
    base, rows = draw.choices(WORDS, k=150), []
    for i in range(200):
        words = list(base)
        for _ in range(draw.randrange(1, 6)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append((i, " ".join(words)))
    found = near_dedup.near_classes(documents(rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(brute(rows)))


def test_similarity_needs_order():
    words = [f"x{i}" for i in range(300)]
    a, b = shingles(" ".join(words)), shingles(" ".join(words[150:] + words[:150]))
    assert len(np.intersect1d(a, b)) > 280 and near_dedup.similarity(a, b) == 0.0
    c = shingles(" ".join(words[:100] + ["new"] + words[100:]))
    assert near_dedup.similarity(a, c) == pytest.approx(292 / (296 + 297 - 292))


def test_occurrences_are_told_apart():
    marks = shingles("a b c d e " * 20)
    assert len(np.unique(marks)) == len(marks) == 96


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (102, 103), (200, 201)]
    found = near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {
        **dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 103: 100, 200: 200, 201: 200,
    }


def test_edges(edges, no_documents):
    found = near_dedup.near_classes(edges)
    assert found.count() == edges.count()
    same = [r for r in found.collect() if r.class_id == 1]
    assert sorted(r.doc_id for r in same) == [1, 2, 2] and sum(r.kept for r in same) == 1
    assert near_dedup.drop_near_copies(edges).columns == edges.columns
    assert near_dedup.near_classes(no_documents).count() == 0
    assert near_dedup.drop_near_copies(no_documents).count() == 0
