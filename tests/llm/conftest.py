import random

import pytest

#: Columns that the operators' own names could clash with.
EXTRA = "removed string, hit string, items string, n_words string, nth string, fp string, digest string, content string, line string, wanted string"


@pytest.fixture(scope="session")
def make(spark):
    def of(rows):
        data = [(i, t, *["x"] * 10) for i, t in rows]
        return spark.createDataFrame(data, f"doc_id long, text string, {EXTRA}")

    return of


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null and equal ids, repeated rows, ties, a very long text, odd characters."""
    long = " ".join(f"word{i % 977} tail" for i in range(60_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (None, "no id here at all, none"),
        (None, None), (4, " \n\t "), (5, "same"), (5, "same"), (5, "other text under one id"), (6, long), (7, "é😀\u0000 x y <|endoftext|> 中文"),
        (8, "The quick brown fox jumps over the lazy dog near the river bank today"),
    ]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies and shared lines, by rule."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    rows = []
    for i in range(160):
        kind = i % 8
        if kind in (5, 6) and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((i, " ".join(words)))
        else:
            lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
            if kind == 7:
                lines.append("this very line is in many of the documents of the corpus")
            rows.append((i, "\n".join(lines)))
    return rows
