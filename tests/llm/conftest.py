import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and clashing column names."""
    words = [f"w{i}" for i in range(400)]
    near = words[:]
    near[200] = "other"
    texts = [
        (1, " ".join(words), "a"), (2, " ".join(near), "a"), (3, " ".join(words).upper(), "b"), (4, "", "b"), (5, None, None),
        (6, " \t\n", "c"), (7, "one two", "c"), (8, "One Two", None), (8, "One Two", None), (9, "one two", "a"), (None, "lost words", "a"),
        (10, " ".join(f"x{i % 7}" for i in range(300)), "b"), (11, "long " * 30_000, "b"), (12, "é" * 5000, "c"),
        (13, "zz " + " ".join(words[50:120]) + " yy", "a"), (14, " ".join(words[100:134]), "b"), (15, " ".join(words[100:135]), "b"),
    ]
    rows = [(d, t, s, 1, "x", 2.0) for d, t, s in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int, digest string, copies double")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
