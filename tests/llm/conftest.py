import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, sig string, part int, `a b` string"
LONG = "lorem ipsum dolor 12 sit amet, " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n\t ", "en", None, 5), (3, "one two", None, "a", 7), (4, "one two three four five six seven eight nine ten", "en", "b", 48),
        (4, "one two three four five six seven eight nine ten", "en", "b", 48), (5, "one two three four five six seven eight nine ten", "de", "b", 48), (6, LONG, "en", "a", len(LONG)), (7, "Ünïcödé ▁ 日本語 😀 é \u0000 x", "fr", "c", 23), (8, "12345 !!! ...", "fr", "c", 13), (9, "x" * 300_000, None, "c", 300_000),
    ]
    return spark.createDataFrame([(*r, 0.5, "s", 1, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
