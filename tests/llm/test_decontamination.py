import hashlib
import re

from tabaudit.llm import decontamination
from tests.llm.conftest import EDGES, LONG

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    wins = set()
    for item_id, text in items:
        w = words(text)
        if item_id is None or not w:
            continue
        for i in range(max(len(w) - size, 0) + 1):
            wins.add((item_id, tuple(w[i : i + min(size, len(w))])))
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item_id))
        joined = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, documents, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontamination.contamination(documents(docs), bench, **kw).collect()), key=repr)


ITEMS = [
    (10, "Some plain text about a house"),
    (11, "one two three four five six seven eight nine ten eleven twelve"),
    (12, "WORD3 stands3 here3"),
    (13, None),
    (None, "plain text"),
    (14, "日本語のテキスト"),
    (11, "one two three four five six seven eight nine ten eleven twelve"),
]


def test_edges_match_brute_force(spark, documents):
    docs = EDGES + [
        (8, "x One two three four five six seven eight nine ten! eleven twelve y"),
        (9, "one two three four five six seven eight nine"),
        (10, "word3 stands3 here3 word3 stands3 here3"),
    ]
    assert run(spark, documents, docs, ITEMS) == brute(docs, ITEMS)
    assert run(spark, documents, docs, ITEMS, limit=0) == brute(docs, ITEMS)


def test_hot_prefix_word_and_overlaps(spark, documents):
    text = " ".join(["a b c d e f g h i j"] * 30 + ["a b c"])
    docs = [(i, text if i % 2 else text.upper()) for i in range(40)] + [(99, "a " * 500)]
    items = [(1, "a b c d e f g h i j a b"), (2, "a a a a a a a a a a a"), (3, "j a")]
    assert run(spark, documents, docs, items, salts=3) == brute(docs, items)
    assert run(spark, documents, docs, items, salts=3, limit=0) == brute(docs, items)


def test_long_text_whole(spark, documents):
    tail = " ".join(LONG.split()[-12:])
    docs = [(1, LONG), (2, tail)]
    items = [(5, tail), (6, " ".join(LONG.split()[:3]))]
    out = run(spark, documents, docs, items)
    assert out == brute(docs, items)
    assert out[0][2] == 15 and out[1][2] == 12


def test_empty_tables(spark, documents, no_documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(no_documents, bench).count() == 0
    rows = decontamination.contamination(documents(EDGES), bench).collect()
    assert len(rows) == len(EDGES) and not any(r.contaminated for r in rows)


def test_sql_matches_query(spark):
    from tests.compare import _rows, connect
    from tabaudit.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    df = QUERIES["op11_decontamination"](spark, folder)
    cur = connect(folder).execute(SQL["op11_decontamination"])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(
        [d[0] for d in cur.description], cur.fetchall()
    )
