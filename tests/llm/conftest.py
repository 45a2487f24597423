import pytest

ODD = [None, "", " ", "\n\n", "one", "one two three four five six", "é" * 50, "x " * 3000, "tab\tand\x0bfeed 漢字 🙂", "same text here again and again"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, and further columns with names that operators use themselves."""
    rows = [(i, t, None if i % 2 else "en", None, None if t is None else len(t), "clash", i) for i, t in enumerate([*ODD, ODD[-1]])]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score bigint")


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)
