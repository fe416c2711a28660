from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np

from stratalog.llm.token_counts import count_tokens, read_cache
from stratalog.llm.tokens import ChunkTokenizer, version_digest, vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())
OURS = ChunkTokenizer(vocabulary_path())


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "B", "é", "É", "é", " ", "\n", " ", "\x1c", "\x85", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "23", "中", "!", "!?", "İ", "ß",
         "Σ", "　", "😀", "\u0000", "×", "÷", "µ", "ª", "²", "hello", "World,", "́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_ids_are_the_librarys(parts):
    text = "".join(parts)
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == expected(text)


def test_counts(spark, make, odd_rows, tmp_path):
    cache = f"file://{tmp_path}/cache"
    got = count_tokens(make(odd_rows), cache, limit=5).collect()
    want = sorted(((i, len((t or "").encode()), n := len(expected(t)), n > 5) for i, t in odd_rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    version = version_digest(vocabulary_path())
    stored = read_cache(spark, cache, version).count()
    n = spark.read.parquet(cache).count()
    assert stored == n == len({t or "" for _, t in odd_rows})
    count_tokens(make([*odd_rows, (9, "new text"), (10, "new  \n text")]), cache).collect()
    assert spark.read.parquet(cache).count() == n + 1  # one content was missing, white space aside
    assert read_cache(spark, cache, "another version").count() == 0


def test_empty_table(make):
    assert count_tokens(make([])).count() == 0
