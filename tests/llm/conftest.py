import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key int, sha int, row int, part string, kind int, bucket string, ids int, spans int"

#: name -> text of the awkward rows
LONG = "alpha beta gamma delta. " * 3000 + "aGVsbG8gd29ybGQ" * 6000 + " end " + "x" * 3000
EDGES = [
    (1, "One plain text with more than five words in it.", "en"),
    (2, "One plain  text\twith more than five words in it.", "en"),
    (2, "One plain  text\twith more than five words in it.", "en"),  # a repeated row
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "en"),
    (6, LONG, "en"),
    (7, LONG, "en"),
    (8, "Und der die das ist nicht schön über ß.", "de"),
    (9, "!!! ### 123 　\x85", None),
    (None, "a row without id and with a secret: token=abcdef123456", "en"),
    (10, "<|endoftext|> don't 's   x​ é 日本語 🎉", "fr"),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, lang, None, None, *([None] * 9)) for i, t, lang in EDGES]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
