import hashlib
import random
import re

import numpy as np
import pytest

from stratalog.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, window=13):
    """(words, hit words, items) by trying each window of each item at each place."""
    words, names = split(text), set()
    hit = [False] * len(words)
    for item, body in items:
        own = split(body)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    names.add(str(item))
                    hit[at : at + n] = [True] * n
    return len(words), sum(hit), sorted(names)


def cases(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "c", "x1", "é", "A", "zz"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    return [text(70) for _ in range(6)] + ["", None], [(str(i), text(10)) for i in range(6)] + [("e", ""), ("f", "zz"), ("f", "a b a")]


@pytest.mark.parametrize("seed", range(40))
def test_shard_against_brute_force(seed):
    texts, items = cases(seed)
    n, masks, names = D.scan_shard(texts, D.Phrases(items, 4))
    assert [(a, int(m.sum()), sorted(i)) for a, m, i in zip(n, masks, names)] == [brute(t, items, 4) for t in texts]


def test_index_ranks_and_suffixes():
    rng = np.random.default_rng(1)
    seq = np.append(rng.integers(0, 6, 400), 0)
    order = D.suffix_array(seq)
    stops = np.cumsum(seq == 0)
    key = lambda i: [(c, stops[i + k] if c == 0 else 0) for k, c in enumerate(seq[i:].tolist())]
    assert order.tolist() == sorted(range(len(seq)), key=key)
    w = D.WaveletMatrix(seq, 3)
    at = rng.integers(0, len(seq) + 1, 200)
    symbol = rng.integers(0, 6, 200)
    assert w.rank(symbol, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(symbol, at)]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hit string")


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
ITEMS = [(7, PASSAGE), (10, "short one"), (11, None), (None, "no id"), (7, PASSAGE)]


def test_rows(spark, make, odd_rows):
    rows = [*odd_rows, (30, f"before it. {PASSAGE.upper()}! after it"), (31, "a short, one " + "w " * 100), (32, " ".join(["filler"] * 400) + " " + PASSAGE)]
    got = D.find_contamination(make(rows), benchmark(spark, ITEMS)).collect()
    want = []
    for i, t in rows:
        n, hit, items = brute(t, [(a, b) for a, b in ITEMS if a is not None])
        want.append((i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert [r.contaminated for r in got if r.doc_id in (30, 31, 32)] == [True, False, False]


def test_blocks_of_the_benchmark_add_up(spark, make):
    texts, items = cases(99)
    rows = list(enumerate(texts))
    named = [(k, t) for k, (_, t) in enumerate(items)]
    one = D.find_contamination(make(rows), benchmark(spark, named), 4)
    many = D.find_contamination(make(rows), benchmark(spark, named), 4, block_bytes=40)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_removal(spark, make):
    rows = [(1, f"x {PASSAGE}. y"), (2, "w " * 300 + f"({PASSAGE}), " + "v " * 300), (3, None), (4, "clean")]
    got = {r.doc_id: r for r in D.decontaminate(make(rows), benchmark(spark, ITEMS)).collect()}
    assert sorted(got) == [2, 3, 4]
    assert got[2].text == "w " * 300 + "(), " + "v " * 300 and got[3].text is None and got[4].hit == "x"


def test_empty_tables(spark, make):
    assert D.find_contamination(make([]), benchmark(spark, ITEMS)).count() == 0
    assert D.find_contamination(make([(1, PASSAGE)]), benchmark(spark, [])).first().n_hit == 0


def test_a_large_benchmark_is_a_small_broadcast():
    """What is sent is the texts of a block, not its windows."""
    import pickle

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)]
    items = [(str(i), " ".join(rng.choices(words, k=500))) for i in range(600)]
    size = sum(len(t) for _, t in items)
    block = D.Block(items, 13)
    assert len(block.phrases.symbols) > 250_000 and len(pickle.dumps(block)) < 1.2 * size + 20_000
