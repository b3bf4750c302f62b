import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, node string, "
    "kept boolean, body string, spans string, hits int, sketches int, words int, range int, length int, class string"
)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text[, lang]) with columns whose names clash with those inside the operators."""

    def build(rows, parts=3):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "x", 1, None, True, "b", "s", 1, 2, 3, 4, 5, "c")
            for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


LONG = " ".join(f"word{i % 997} stands{i % 31} here{i}" for i in range(40_000))
EDGES = [
    (1, "Some plain text about a house and a garden."),
    (2, "some plain text about a house and a garden."),
    (2, "some plain text about a house and a garden."),
    (3, None),
    (4, ""),
    (None, "a row without a number"),
    (None, None),
    (5, LONG),
    (6, "12345 !!! \n\n ..."),
    (7, "日本語のテキスト 🎉 ▁ x²"),
]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(EDGES)


@pytest.fixture(scope="session")
def no_documents(documents, spark):
    return documents(EDGES).filter("false")
