import pytest

LONG = "der schnelle braune fuchs springt\n" * 9000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the idiot dog", "en", "b", 1),
        (1, "the cat sat on the mat and looked at the idiot dog", "en", "b", 1),
        (2, "the cat sat on the mat and looked at the idiot dog", "en", "a", 1),
        (3, "", "en", "a", 0), (4, None, "en", "a", None), (5, "   \t\n", None, None, 5), (6, "123 456 !!", "de", None, 9),
        (None, "der hund und die katze sitzen auf der matte", "de", "c", 3), (None, None, None, None, None),
        (7, LONG, "de", "c", len(LONG)), (8, "▁ literal sign and \U0001f600 emoji", None, "a", 4), (9, "word", "en", "\U0001f600", 1),
        (10, "le chat est sur la table et le chien dort", "fr", "d", 2),
    ]
    clash = ", ".join(f"{n} string" for n in ("size", "hash", "_hash", "_mix", "_at", "_t", "features", "fingerprint", "doc", "_language"))
    kept = tuple("kept" for _ in clash.split(", "))
    return spark.createDataFrame(
        [r + kept for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def few_labels(spark):
    rows = [(1, 1, 1), (1, 1, 0), (3, 0, 0), (None, 1, 1), (7, None, 0), (10, 1, None), (9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
