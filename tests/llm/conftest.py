import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SECRET = "0123456789abcdef0123456789abcdef"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(40_000))
AWKWARD = [
    (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "One two three", "en"), (4, "One two three", "en"), (5, "one TWO three", None), (6, LONG, "de"), (7, LONG + " end", "de"),
    (8, LONG, "fr"), (9, "été ÉTÉ Straße 日本語 😀 don't x²y", "fr"), (10, f"token = {SECRET} rest", "en"), (None, "a row without id", "en"), (11, "a\x00b\x1fc <|endoftext|> d", "en")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names used inside."""
    rows = [(i, t, l, "src", None if t is None else len(t), "x", 1, [1], b"k", 0.5) for i, t, l in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string, key int, spans array<int>, node binary, n double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.limit(0)
