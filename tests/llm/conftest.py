import random

import pytest

SF_DIR = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies string"


@pytest.fixture(scope="session")
def dirty(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randint(1, 7)))
    texts = [" ".join(word() for _ in range(draw.randint(0, 60))) for _ in range(40)]
    texts += ["", None, " \t\n", "A b", "a B", "x" * 5000, "long words " * 3000, texts[0], texts[0]]
    rows = [(n, text, "en", f"s{n % 3}", None, "x", "y") for n, text in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, None, None), (7, "same id", None, None, 1, "z", "z")]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
