import random
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import language as L

PATH = L.vocabulary_path("piece_bpe_32k.model")
EXTRA = "score string, held_out string, lang_pred string, n string"


@pytest.fixture(scope="module")
def pieces():
    return L._pieces(PATH)


@cache
def spelled():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))}


def ways(word):
    """All ways to write a word, as lists of pieces."""
    known = spelled()
    signs = [x for c in "▁" + word for x in ([c] if c in known else [f"<0x{b:02X}>" for b in c.encode("utf-8", "replace")])]

    def rest(k):
        if k == len(signs):
            yield []
        for e in range(k + 1, len(signs) + 1):
            if (piece := "".join(signs[k:e])) in known and (e == k + 1 or "<0x" not in piece):
                for more in rest(e):
                    yield [known[piece], *more]

    return list(rest(0))


def some_log_p(pieces, n=3):
    p = np.random.default_rng(2).dirichlet(np.full(pieces.n, 0.3), n).T + 1e-9
    return np.log(p / p.sum(0))


words = st.one_of(st.text("abcdeéßlmnorst", min_size=1, max_size=8), st.text(min_size=1, max_size=3), st.sampled_from(["the", "中文", "ñandú", "🙂", "ﬁn"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=6))
def test_scores_and_counts_against_all_ways(pieces, some):
    log_p = some_log_p(pieces)
    got = L.word_scores(some, log_p, pieces)
    language = np.arange(len(some)) % 3
    counts = L.expected_counts(some, language, np.full(len(some), 2.0), log_p, pieces)
    want = np.zeros_like(counts)
    for k, word in enumerate(some):
        each = [sum(log_p[i] for i in way) for way in ways(word)]
        total = np.logaddexp.reduce(np.array(each), axis=0)
        assert np.allclose(got[k], total, rtol=1e-9)
        for way, p in zip(ways(word), each):
            for i in way:
                want[i, language[k]] += 2 * np.exp(p - total)[language[k]]
    assert np.allclose(counts, want, atol=1e-9)


def test_long_and_rare_words_are_summed_by_logarithms(pieces, monkeypatch):
    log_p = some_log_p(pieces)
    some = ["a" * 300, "straße" * 5, "x", "中文字" * 9, "é" * 47, "b" * 47, "c" * 48]
    own, times = np.zeros(len(some), int), np.ones(len(some))
    one = L.word_scores(some, log_p, pieces), L.expected_counts(some, own, times, log_p, pieces)
    monkeypatch.setattr(L, "LEAST", 1e300)
    two = L.word_scores(some, log_p, pieces), L.expected_counts(some, own, times, log_p, pieces)
    for a, b in zip(one, two):
        assert np.isfinite(a).all() and np.allclose(a, b, rtol=1e-9)
    # an expected count for each symbol: pieces' lengths add up to those of the words
    lengths = {i: 1 if p.startswith("<0x") else len(p) for p, i in spelled().items()}
    assert np.isclose(sum(one[1][i, 0] * n for i, n in lengths.items()), len(pieces.symbols(some)[0]))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def texts(n=240):
    rng = random.Random(6)
    parts = {"aa": "ing the tion of er an".split(), "bb": "que les ment ou é aux".split(), "": "sch ung der ein ß ü".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, lang, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], f"doc_id long, lang string, text string, {EXTRA}")


def test_held_out_accuracy_and_no_leak(spark):
    rows = texts()
    got = {r.doc_id: r for r in L.predict_languages(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == held_out(i) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    out = [got[i].lang_pred == lang for i, lang, _ in rows if held_out(i)]
    assert sum(out) / len(out) > 0.97
    wrong = [(i, "zz" if held_out(i) else lang, t) for i, lang, t in rows]
    again = {r.doc_id: r for r in L.predict_languages(frame(spark, wrong)).collect()}
    assert all(again[i].lang_pred == got[i].lang_pred and abs(again[i].score - got[i].score) < 1e-9 for i in got)


def test_odd_rows(spark):
    long = "word " * 40_000 + "x" * 5_000
    odd = [(None, "aa", "the tion"), (1000, None, "the ing"), (1001, "aa", None), (1002, "bb", ""), (1003, "bb", "123 ... ² 🙂"), (1004, "aa", long), (5, "aa", "des les"),
           (5, "aa", "des les"), (1005, "bb", "́́"), (1006, None, "中文"), (1007, "aa", "a\x00b")]
    got = L.predict_languages(frame(spark, texts(60) + odd)).collect()
    assert len(got) == 60 + len(odd)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1001, 1002, 1003, 1005}
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and all(r.lang_pred in ("aa", "bb", "") for r in got if r.doc_id in (None, 1000, 1006))
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert L.predict_languages(frame(spark, [])).count() == 0
    none = L.predict_languages(frame(spark, [(i, None, t) for i, _, t in texts(9)])).collect()
    assert all((r.lang_pred, r.score) == ("und", 0) for r in none)


def test_model_against_plain_counts(spark, pieces):
    """One round from equal probabilities: expected counts over all ways of all words, one by one."""
    rows = texts(12)
    model = L.learn(frame(spark, rows), PATH, 1)
    counts = np.zeros((pieces.n, len(model.names)))
    for i, lang, text in rows:
        for word in [] if held_out(i) else text.split():
            each = [(way, pieces.n ** -float(len(way))) for way in ways(word)]
            for way, p in each:
                for k in way:
                    counts[k, model.names.index(lang)] += p / sum(q for _, q in each)
    assert np.allclose(model.log_p, L.maximised(counts), atol=2e-4)  # counts are rounded
