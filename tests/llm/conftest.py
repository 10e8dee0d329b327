"""Documents with nulls, empty and long texts, ties, repeats, and extra columns with awkward names."""

import os

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, key string, words string"
LONG = "lorem ipsum dolor sit amet " * 3000


def document_rows():
    texts = [
        None, "", " \t\n", "one", "The quick brown fox jumps over the lazy dog and runs away from it.",
        "The quick brown fox jumps over the lazy dog and runs away from it.", LONG, "Don't PANIC, it's 42 €! naïve ΣΑΣ ﬁ <|endoftext|> x",
        "Released under the MIT License.\nAll rights reserved.", "all rights reserved.\nAll rights reserved.\nMit license",
    ]
    rows = [(i, t, "en", f"s{i % 3}", None, None, i, "k", "w") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(document_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
