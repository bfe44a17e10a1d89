import pytest

#: A document table with a null in every column, repeated rows, ties, an empty text and columns with clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id string, score string, ids string, _dropped string"


@pytest.fixture(scope="session")
def odd(spark):
    long = "word " * 30_000
    rows = [
        (0, "Plain text of a page.\nA second line here.", "en", "s"),
        (1, None, "en", "s"),
        (2, "", None, None),
        (3, long, "en", "s"),
        (4, "Plain text of a page.\nA second line here.", "en", "s"),
        (4, "Plain text of a page.\nA second line here.", "en", "s"),
        (None, "12345 !!! ...", "de", "t"),
        (5, "   \t\n ", "en", "t"),
        (6, "ÄÖÜ ß 日本語 😀 <|endoftext|> a@b.com", "de", "t"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "i", "d") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
