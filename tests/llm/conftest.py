import re

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
WORDS = [f"word{i}" for i in range(400)]


def sentence(start: int, n: int = 40) -> str:
    return " ".join(WORDS[(start + 7 * i) % 400] for i in range(n))


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and keys, and columns with clashing names."""
    rows = [
        (1, sentence(0), "en", "a"), (2, sentence(0), "en", "a"), (2, sentence(0), "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (None, sentence(1), "en", None), (None, None, None, None), (5, LONG, "en", "b"), (6, LONG + " tail", None, "b"), (7, "\n\n \n", "en", "c"),
        (8, "one", "en", "c"), (8, "two words", "en", "c"), (9, "Ünïcode 😀 ~0 <|im_end|> \\ ' \" text", "xx", "c"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1, "x", 2.0) for r in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long, size string, id int, node string, hash double")
    return frame


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").lower()).split()
