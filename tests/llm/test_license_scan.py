import re

from tabaudit.llm import license_scan
from tabaudit.llm.license_scan import NOTICES, PHRASES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "MIT license, MIT License; the GNU General Public  License. CC BY-NC 4.0",
    "gnu general öffentlich public license apache-license mitlicense",
    "cc by cc by cc",
    "Permission is hereby granted, free of charge, to any PERSON obtaining one copy of this software and associated "
    "documentation files (the Software), to deal in the Software without any restriction",
    "permission is hereby granted to nobody",
    "ÀMIT licenseé mit license",
    None,
    "",
]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    own = words(text)
    places = [
        (i, label)
        for phrase, label in PHRASES
        for i in range(len(own))
        if own[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return (
        len(own),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


def test_base_matches_brute_force(documents):
    rows = list(enumerate(TEXTS))
    found = license_scan.licenses(documents(rows)).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found}
    assert got == {i: brute(t) for i, t in rows}
    labels = {r.doc_id: r.labels for r in found}
    assert labels[0] == "apache,apache-2.0" and labels[5] == "" and all(0 <= r.score <= 1 for r in found)
    assert labels[4] == "mit", "an edited notice is found over neighbouring diagonals"


def test_whole_notices(documents):
    rows = [(i, text) for i, (text, _) in enumerate(NOTICES)]
    found = {r.doc_id: r.labels.split(",") for r in license_scan.licenses(documents(rows)).collect()}
    assert all(label in found[i] for i, (_, label) in enumerate(NOTICES))


def test_data_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        for r in license_scan.licenses(docs).collect()
    }
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_edges(edges, no_documents):
    assert license_scan.licenses(edges).count() == edges.count()
    assert license_scan.licenses(no_documents).count() == 0
