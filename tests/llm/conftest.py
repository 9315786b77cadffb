import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept boolean, fp long, row long, score double"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns with the operators' own names."""
    long_text = " ".join(f"word{i % 997} of{i}" for i in range(6000))
    rows = [
        (1, "The same text as before, word for word and more", "en", "a"),
        (2, "the SAME text as before, word for word and more", "en", "a"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, "   \n\t ", "de", "b"),
        (6, long_text, "en", "b"),
        (7, "Ünïcode ÄÖÜ straße naïve 日本語 text", "de", "c"),
        (None, "no id at all in this one", "en", "c"),
        (8, "repeated row", "en", "c"),
        (8, "repeated row", "en", "c"),
        (9, "!!! 123 ???", None, "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "d", True, 5, 6, 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
