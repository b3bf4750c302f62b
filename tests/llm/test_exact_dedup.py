import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tabaudit.llm import exact_dedup
from tests.llm.conftest import EDGES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lower(text)].append(doc_id)
    out = set()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out |= {(i, keep, len(ids), i == keep, sha) for i in ids}
    return out


def test_groups_match_brute_force(edges):
    assert {tuple(r) for r in exact_dedup.exact_groups(edges).collect()} == brute(EDGES)


def test_only_ascii_letters_fold(documents):
    rows = [(1, "ÀB"), (2, "àb"), (3, "Àb"), (4, "K"), (5, "k")]
    assert {tuple(r) for r in exact_dedup.exact_groups(documents(rows)).collect()} == brute(rows)


def test_texts_that_share_a_digest_stay_apart(documents, monkeypatch):
    own = exact_dedup._texts
    monkeypatch.setattr(exact_dedup, "_texts", lambda docs: own(docs).withColumn("digest", F.lit("same")))
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "b")]
    found = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(documents(rows)).collect()}
    assert found == {1: 2, 2: 2, 3: 5, 4: 4, 5: 5}


def test_hot_group(documents):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"cold {i}") for i in range(200)]
    assert {tuple(r) for r in exact_dedup.exact_groups(documents(rows)).collect()} == brute(rows)


def test_rows_that_stay(edges):
    kept = exact_dedup.drop_exact_copies(edges)
    assert kept.columns == edges.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t, *_ in EDGES})
    assert {r.doc_id for r in kept.collect() if lower(r.text).startswith("some plain")} == {2}


def test_empty_table(no_documents):
    assert exact_dedup.exact_groups(no_documents).count() == 0
    assert exact_dedup.drop_exact_copies(no_documents).count() == 0
