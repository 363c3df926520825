import random

import pytest

from matchweave.llm.shared import Workspace


@pytest.fixture
def space(spark, tmp_path):
    return Workspace(spark, "test")


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) if rng.random() < 0.5 else f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, equal and null ids, a very long word and a long text, and columns whose names operators use inside."""
    long_text = prose(1, 5000)
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, long_text), (5, long_text), (None, prose(2, 60)), (None, None), (6, "x" * 20000), (7, prose(3, 80)), (7, prose(4, 80)), (8, "\u2028 naïve　日本語 'tis <|endoftext|> don't\u00a0x \x85"), (9, prose(3, 80))]
    rows = [(i, t, "en", "s", len(t or ""), 1, "b", True) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, bits string, kept boolean")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
