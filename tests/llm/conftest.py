import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (id, text) rows, with the other columns filled or null."""

    def make(rows, schema=SCHEMA):
        full = [(i, t, "en" if i != 3 else None, "src", len(t) if t else None) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and blank texts, a repeated row, a null id, a long text, odd characters."""
    return documents(
        [
            (1, "The cat sat on the mat.\nThe cat sat."),
            (1, "The cat sat on the mat.\nThe cat sat."),
            (2, None),
            (3, ""),
            (4, " \n\t "),
            (5, "word " * 30_000),
            (6, "é漢字 \x00 😀 a b c <s> <|endoftext|> ▁x"),
            (7, "x" * 5000),
            (8, "The cat sat on the mat.\nThe cat sat."),
            (None, "no id at all"),
        ]
    )
