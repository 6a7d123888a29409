"""Documents that the tests of this folder share; fixtures are imported where used."""

import pytest

SF = "/root/testdata/sf0.001"

#: Null, empty, blank, one-word, repeated, mixed-script and long texts.
ODD = [
    (0, "a man a plan a canal panama and then some more words"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "x"),
    (5, "A man a plan a canal panama and then some more words"),
    (6, "1234 !!! ???"),
    (7, "café 你好 \U0001f600 é     end"),
    (8, "word " * 30_000),
    (9, "x" * 100_000),
    (9, "x" * 100_000),
    (None, "a text without identifier"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with odd texts and columns whose names operators might use themselves."""
    rows = [
        (i, t, "en", "s", None if t is None else len(t), 1.5, "p", i, 7, 1) for i, t in ODD
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, score double, "
        "fingerprint string, component_id long, copy int, tie int",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
