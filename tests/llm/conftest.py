import pytest

#: Columns whose names clash with those that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, row int, score double, label string, copies int, sha int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""

    def of(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 7, "h", 1, 0.5, None, 3, 4) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "word " * 30_000
    return make([(1, None, None), (2, "", "a"), (3, "", "a"), (None, "no id here", "b"), (None, None, None), (4, long, "b"), (4, long, "b"), (5, "x" * 20_000, None), (6, "\x00 日本 ÀÉ 🙂", "a"), (7, "same text", "a"), (8, "SAME text", "a")])
