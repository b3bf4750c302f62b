import re
from collections import Counter

from tabaudit.llm import divergence
from tests.llm.conftest import EDGES, LONG

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    docs = [(r[2] or "", (r[3] if len(r) > 3 else None) or "", TERM.findall(lower(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        vocab = sorted(t for t, n in df.items() if n >= 10)
        v = len(vocab)
        sources = sorted({d[1] for d in mine})
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= 10) for s in sources}
        whole = Counter(t for d in mine for t in d[2] if df[t] >= 10)

        def p(c, t):
            n = sum(c.values())
            return 1 + 10**9 * (c[t] + 2) // (n + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(h, sum(f(p(count[s], t), p(count[h], t)) for t in vocab)) for h in sources if h != s]
            pairs.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "pair", h, val, i + 1) for i, (h, val) in enumerate(pairs)]
            terms = [(t, f(p(count[s], t), p(whole, t))) for t in vocab if count[s][t] > 0 and p(count[s], t) > p(whole, t)]
            terms.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "term", t, val, i + 1) for i, (t, val) in enumerate(terms[:10])]
    return sorted(out)


def run(documents, spark, rows, **kw):
    docs = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3] if len(r) > 3 else None) for r in rows], "doc_id long, text string, lang string, source string"
    )
    return sorted(tuple(r) for r in divergence.divergence(docs, **kw).collect())


ROWS = (
    [(i, f"Alpha beta{'x' * (i % 3)} gamma delta alpha {i % 5} Épée", "en", f"s{i % 3}") for i in range(40)]
    + [(100 + i, "alpha alpha beta rare" + " beta" * i, "en", "hot") for i in range(12)]
    + [(200, None, "en", "empty"), (201, "12345", None, None), (202, "ein zwei", "de", "only")]
    + [(300 + i, "ein drei", None, "x") for i in range(11)]
    + [(400 + i, "un deux", "fr", f"f{i % 2}") for i in range(3)]
    + [(r[0], r[1], "en", None) for r in EDGES]
    + [(500, LONG, "en", "s1"), (500, LONG, "en", "s1")]
)


def test_matches_brute_force(spark, documents):
    assert run(documents, spark, ROWS) == brute(ROWS)
    assert run(documents, spark, ROWS, groups_limit=0) == brute(ROWS)


def test_empty_table(spark, documents):
    assert run(documents, spark, []) == []


def test_sql_matches_query(spark):
    from tests.compare import _rows, connect
    from tabaudit.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    df = QUERIES["op13_divergence"](spark, folder)
    cur = connect(folder).execute(SQL["op13_divergence"])
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine == _rows([d[0] for d in cur.description], cur.fetchall()) and mine[1]
