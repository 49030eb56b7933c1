import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture
def docs(spark):
    """Documents with nulls in every column, an empty and a very long text, repeated rows, and a column name that clashes."""
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (3, 7, 11, 5))
    passage = " ".join(word(i) for i in range(60))
    rows = [
        (1, "Hello world, it's 2026! " + passage + " tail one", "en", "a", 5, "x"), (2, "other start " + passage + " another end", "en", "a", None, None),
        (3, "", None, None, 0, None), (4, None, "en", None, None, "y"), (None, "no id here, but words " * 3, None, "b", 1, None),
        (5, "same text here\nand a line\nand a line", "de", "b", 3, "z"), (5, "same text here\nand a line\nand a line", "de", "b", 3, "z"), (6, "same text here\nand a line\nand a line", "de", "b", 3, "z"),
        (7, " ".join(word(i * i) for i in range(6000)), "fr", "c", 9, None), (8, "ñandú ☃ 💡 <|endoftext|> ok x", "es", "c", 9, None), (9, "a" * 5000, None, None, None, None), (10, " ".join(["la"] * 300), None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(docs):
    return docs.limit(0)
