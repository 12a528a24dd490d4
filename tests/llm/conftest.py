import random

import pytest


@pytest.fixture
def table(spark):
    """A frame of documents with every column and some more, whose names clash with what operators use inside."""

    def make(texts):
        pairs = texts if texts and isinstance(texts[0], tuple) else enumerate(texts)
        rows = [(i, t, "en", f"src{(i or 0) % 3}" if i is not None else None, len(t or ""), (i or 0) * 2, "x", -1.0) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, label string, score double")

    return make


#: Texts that every operator has to bear.
ODD = [None, "", " \n\t ", "one", "a b c", "Ünïcode ß 中文 😀", "x" * 5000, "the same words again " * 300, "\x00nul and | pipes", "line\n" * 50, "tie tie", "tie tie"]


def prose(rng: random.Random, n: int, words: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)
