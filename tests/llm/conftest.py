import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, g0 long, kept string, label string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as (doc_id, text) or (doc_id, text, source); the table has more columns, with names the operators use."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", "y") for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, equal texts, a repeated id and a very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one two three"), (6, "One two  three"), (None, "lost id here we go"), (None, None), (7, long), (8, long), (9, "é\u3000ü ß\u00a0x"), (9, "another text of nine")]
