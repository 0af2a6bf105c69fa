import pytest

ODD_TEXTS = [
    (1, "One two three four five six. " * 30),
    (2, "One two three four five six. " * 30),
    (2, "One two three four five six. " * 30),
    (3, None),
    (None, "a text without an id, that still has some words in it"),
    (None, None),
    (4, ""),
    (5, " \n\t \x0b "),
    (6, "word"),
    (7, "x" * 150_000),
    (8, "lorem ipsum dolor sit amet " * 8_000),
    (9, "été à la naïve ßtraße 日本語 😀   　 end"),
    (10, "MAIL me@example.com, +1 (555) 010-9999 or 10.0.0.1; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""),
    (11, "0" * 40_000),
    (12, "@" * 5_000 + "." * 5_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with NULLs, empty and very long texts, repeats, and columns named like those of operators."""
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, spans string, "
        "row_key long, text_key long, component_id long, `values` string, part int, `a.b` int"
    )
    rows = [(i, t, "en" if i else None, "s", len(t or ""), None, None, None, None, None, None, None, None, None) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def documents(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet")
