import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import runs as R


def brute_runs(w, least_length=24, least_times=3):
    """Every maximal stretch of every period, smallest periods first."""
    n, found = len(w), {}
    for p in range(1, n // least_times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - a + p
            if length >= max(least_length, least_times * p):
                found.setdefault((a, length), p)  # larger periods of one stretch are multiples
    return sorted(((a, length, p) for (a, length), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else x for i, x in enumerate(words)]
    found = brute_runs(words)
    gone = {k for a, length, p in found for k in range(a + p, a + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(words) if i not in gone)),
    )


pieces = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 14), st.integers(0, 5))


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=6), st.sampled_from([(24, 3), (4, 2), (6, 3), (1, 2)]))
def test_runs_against_brute_force(parts, least):
    w = [x for part, times, cut in parts for x in (part * times)[cut:]]
    assert R.find_runs(np.array(w, np.int64), *least) == brute_runs(w, *least)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=120))
def test_two_letters(s):
    w = [ord(c) for c in s]
    assert R.find_runs(np.array(w, np.int64), 2, 2) == brute_runs(w, 2, 2)


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all words every stretch of equal length looks equal; the result holds."""
    monkeypatch.setattr(R, "_mixed", lambda x: np.ones(len(x), np.uint64))
    rng = random.Random(1)
    for _ in range(60):
        w = [x for _ in range(4) for x in [rng.randrange(3) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9)]
        at = R.Stretches(np.array(w, np.int64))
        for _ in range(20):
            i, j = sorted(rng.sample(range(len(w)), 2)) if len(w) > 1 else (0, 0)
            if i == j:
                continue
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            m = 0
            while m < i and w[i - 1 - m] == w[j - 1 - m]:
                m += 1
            assert at.right(i, j) <= k and (k < 8 or at.right(i, j) >= 8)
            assert at.left(i, j) <= m


def test_report_against_brute_force(spark, make, corpus, odd_rows):
    rng = random.Random(4)
    rows = [(i, t if i % 3 else " ".join([*t.split()[:9], *(t.split()[:5] * 9), *t.split()[9:40]])) for i, t in corpus]
    rows += [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [r for r in odd_rows if len(r[1] or "") < 9999]
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, R.run_report(make(rows)).collect()), key=key)
    assert got == sorted((brute_report(*r) for r in rows), key=key)
    assert R.run_report(make([])).count() == 0
    assert R.run_report(make(odd_rows)).count() == len(odd_rows)


def test_collapse_and_rows(spark, make):
    text = "start of it " + "buy now here " * 20 + "the end"
    docs = make([(1, text), (2, "no  run\there"), (3, None), (4, "")])
    got = {r.doc_id: r for r in R.collapse_runs(docs).collect()}
    assert got[1].text == "start of it buy now here the end" and got[1].removed == "x"
    assert (got[2].text, got[3].text, got[4].text) == ("no  run\there", None, "")
    assert [tuple(r) for r in R.text_runs(docs).collect()] == [(1, 3, 60, 3, "buy now here")]


def test_time_of_hostile_texts():
    fib = [1], [1, 0]
    while len(fib[1]) < 60_000:
        fib = fib[1], fib[1] + fib[0]
    n = 60_000
    for w in ([0] * n, [0, 1] * (n // 2), fib[1], [bin(i).count("1") % 2 for i in range(n)], ([0] * 150 + [1]) * (n // 151), list(range(200)) * (n // 200)):
        began = time.process_time()
        R.find_runs(np.array(w, np.int64))
        assert time.process_time() - began < 5
