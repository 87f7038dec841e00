import pytest

LONG = "the quick brown fox jumps over 12 lazy dogs " * 4000 + "x" * 30_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns named like results."""
    texts = [None, "", " \n\t ", "a", "one two", LONG, "same text here for all of you", "same text here for all of you", "Grüße aus Köln, 日本語 <|endoftext|> x\x1cy\u00a0z", "!!! ### 123"]
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", i, -1, "x", True) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, ids string, kept boolean")
