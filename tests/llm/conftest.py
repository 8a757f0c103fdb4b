import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from tessera.session import ship_package
    ship_package(spark)
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, block string, _w int"


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns with the names that operators add."""
    base = ("The quick brown fox jumps over the lazy dog and then it runs to the river in the town with a friend of "
            "the house, for it is the way that they go to be at home on the hill as was told by the old people. "
            "Another part of this text is about the sea and the ships in it, with some words that are not in the first. ")
    long = " ".join(f"word{i % 977} the of and to in" for i in range(6000))
    rows = [
        (1, base, "en", "a", 1, "x", "y", 1), (1, base, "en", "a", 1, "x", "y", 1),       # repeated row
        (2, base + "One more sentence at the end.", "en", "a", 2, None, None, None),      # near copy
        (3, None, None, None, None, None, None, None), (4, "", "en", "a", 0, "", "", 0),
        (5, " \n\t ", "en", "b", 3, "x", "y", 1), (6, long, "en", "b", 5, "x", "y", 1),
        (None, base, "en", "c", 1, "x", "y", 1), (None, None, None, None, None, None, None, None),
        (7, "short text", "en", "", 1, "x", "y", 1), (8, "short text", "en", "b", 1, "x", "y", 1),
        (9, "Ünïcode ßtraße 日本語 text – with … marks 😀 and the rest of the line\nline\nline\n", "de", "b", 1, "x", "y", 1),
        (10, "spam " * 300, "en", "b", 1, "x", "y", 1), (-5, "a" * 500, "en", "b", 1, "x", "y", 1),
        (11, base.upper(), "en", "b", 1, "x", "y", 1), (12, "a\u0000b \x07 c", "en", "b", 1, "x", "y", 1),
    ]
    return llm.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)
