"""Language of texts by unigram models over the pieces of a public vocabulary.

A word is written by pieces in many ways; its probability in a language is the sum over all
of them of the product of the pieces' probabilities, found by a forward pass over the lattice
of its pieces. No piece crosses a word's start, so a text's probability is the product over
its words. The probabilities of a language's pieces are those that expectation maximisation
finds: forward and backward passes over all distinct words of its texts, each with its count.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import by_text, discard, map_batches, stored
from stratalog.llm.tokens import vocabulary_path

#: Rounds of expectation maximisation, pieces' counts that a language has beforehand (dealt
#: out as all languages together have them), and the same for all languages together.
ROUNDS, PRIOR, FLAT = 2, 200.0, 1000.0
#: Languages at most: the model, a number a piece and language, is sent to all tasks.
MOST_LANGUAGES = 256
#: Symbols of a word beyond which it is scored by itself, cells of the table for words scored
#: together, and bytes of the scores of words that a worker keeps.
LONG, CELLS, KEPT_BYTES = 48, 2_000_000, 64 << 20
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000

#: Symbols are code points and, from here on, the bytes of characters that are no piece.
_BYTES, _CODE_BITS = 0x110000, 21
_START = "▁"
#: Sums are of probabilities times a factor for each symbol, so that those of words stay far
#: from 0; a word whose sum is less than LEAST all the same is summed up by logarithms.
_FACTOR, _BYTE_FACTOR, LEAST = np.log(12.0), np.log(1e6), 1e-250


@dataclass
class Lattice:
    """Edges of the lattices of words: the word, the symbols before its end, its length, its piece."""

    word: np.ndarray
    end: np.ndarray
    length: np.ndarray
    piece: np.ndarray

    def groups(self) -> list[tuple[int, int, slice]]:
        """(end, length, edges) by end and then length, edges being sorted so: no word is twice in one."""
        key = (self.end * 64 + self.length).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        self.word, self.end, self.length, self.piece = (x[order] for x in (self.word, self.end, self.length, self.piece))
        key = key[order]
        cut = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])).tolist()
        return [(int(key[a]) >> 6, int(key[a]) & 63, slice(a, b)) for a, b in zip(cut, [*cut[1:], len(key)])]


class Pieces:
    """The pieces of a sentencepiece vocabulary as a trie of symbols.

    A character that is no piece of its own is written by its bytes, each of which is one, so
    that every word has a lattice.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.get_piece_size()
        spelled = {}
        for i in range(self.n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled[(_BYTES + int(piece[3:5], 16),)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                spelled[tuple(map(ord, piece))] = i
        self.known = np.zeros(_BYTES + 256, bool)
        nodes = {(): 0}
        for symbols in spelled:
            for k in range(1, len(symbols) + 1):
                nodes.setdefault(symbols[:k], len(nodes))
            if len(symbols) == 1:
                self.known[symbols[0]] = True
        self.longest = max(map(len, spelled))
        self.piece = np.full(len(nodes), -1, np.int64)
        for symbols, i in spelled.items():
            self.piece[nodes[symbols]] = i
        #: log of the factors of a piece's symbols
        self.factor = np.zeros(self.n)
        for symbols, i in spelled.items():
            self.factor[i] = _BYTE_FACTOR if symbols[0] >= _BYTES else _FACTOR * len(symbols)
        # steps of the trie: a hash table that is a quarter full at most
        self.mask = (1 << (4 * len(nodes)).bit_length()) - 1
        self.keys, self.targets = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        for symbols, node in nodes.items():
            if symbols:
                key = nodes[symbols[:-1]] << _CODE_BITS | symbols[-1]
                slot = int(self._slot(np.array([key]))[0])
                while self.keys[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.targets[slot] = key, node

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(36)).astype(np.int64) & self.mask

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that symbols lead to, -1 where there is none."""
        key = node << _CODE_BITS | code
        slot = self._slot(key)
        seen = self.keys[slot]
        while len(on := np.flatnonzero((seen != key) & (seen >= 0))):
            slot[on] = (slot[on] + 1) & self.mask
            seen[on] = self.keys[slot[on]]
        return np.where(seen == key, self.targets[slot], -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, a start sign before each, and how many each word has."""
        codes = np.frombuffer("".join([_START + w for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        odd = np.flatnonzero(~self.known[codes])
        if not len(odd):
            return codes, n
        word_of = np.repeat(np.arange(len(words)), n)
        raw = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8).astype(np.int64) + _BYTES for c in codes[odd].tolist()]
        size = np.ones(len(codes), np.int64)
        size[odd] = [len(r) for r in raw]
        out = np.repeat(codes, size)
        at = (np.cumsum(size) - size)[odd]
        for a, r in zip(at.tolist(), raw):
            out[a : a + len(r)] = r
        return out, np.bincount(word_of, size, len(words)).astype(np.int64)

    def lattice(self, codes: np.ndarray, n: np.ndarray) -> Lattice:
        """All pieces in words of n symbols each, written one after another in codes."""
        start = np.cumsum(n) - n
        word = np.repeat(np.arange(len(n)), n)
        left = (start + n)[word] - np.arange(len(codes))  # symbols from here to the word's end
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for length in range(1, self.longest + 1):
            inside = left[at] >= length
            at, node = at[inside], node[inside]
            node = self._step(node, codes[at + length - 1])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            piece = self.piece[node]
            full = piece >= 0
            found.append((at[full], np.full(int(full.sum()), length), piece[full]))
        at, length, piece = (np.concatenate(c) for c in zip(*found))
        return Lattice(word[at], at - start[word[at]] + length, length, piece)

    def factors(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log of the factors of all symbols of each word."""
        each = np.where(codes >= _BYTES, _BYTE_FACTOR, _FACTOR)
        return np.bincount(np.repeat(np.arange(len(n)), n), each, len(n))

    def chunks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of words, their symbols, how many each has): words of like lengths together."""
        codes, n = self.symbols(words)
        start, order, at = np.cumsum(n) - n, np.argsort(n, kind="stable"), 0
        while at < len(order):
            size = n[order[at : at + CELLS // 2]] + 1
            fit = int(np.searchsorted(np.arange(1, len(size) + 1) * size, CELLS, "right"))
            some = order[at : at + max(1, fit)]
            if n[some[-1]] > LONG:  # as many as are short, or one
                some = some[: max(1, int((n[some] <= LONG).sum()))]
            own = n[some]
            place = np.repeat(start[some] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            yield some, codes[place], own
            at += len(some)


@lru_cache(1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _alone(lattice: Lattice, n: int, log_p: np.ndarray, backward: bool = False) -> np.ndarray:
    """Forward (or backward) sums of one long word: a row for each place, a column a language."""
    sums = np.full((n + 1, log_p.shape[1]), -np.inf)
    sums[n if backward else 0] = 0
    order = np.lexsort((lattice.length, lattice.end - lattice.length if backward else lattice.end))
    for k in order[::-1] if backward else order:
        end, piece = lattice.end[k], lattice.piece[k]
        a = end - lattice.length[k]
        to, of = (a, end) if backward else (end, a)
        sums[to] = np.logaddexp(sums[to], sums[of] + log_p[piece])
    return sums


def word_scores(words: list[str], log_p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """(word, language): log of the sum over all ways to write a word of the product of its pieces'
    probabilities. log_p: (piece, language)."""
    out = np.zeros((len(words), log_p.shape[1]))
    p = np.exp(log_p + pieces.factor[:, None])
    for some, codes, n in pieces.chunks(words):
        lattice = pieces.lattice(codes, n)
        if n[-1] > LONG:
            out[some] = _alone(lattice, int(n[0]), log_p)[-1]
            continue
        sums = np.zeros((int(n[-1]) + 1, len(n), log_p.shape[1]))
        sums[0] = 1
        for end, length, edges in lattice.groups():
            word = lattice.word[edges]
            sums[end, word] += sums[end - length, word] * p[lattice.piece[edges]]
        total = sums[n, np.arange(len(n))]
        low = (total < LEAST).any(1)
        out[some] = np.log(np.maximum(total, LEAST)) - pieces.factors(codes, n)[:, None]
        for k in np.flatnonzero(low).tolist():
            own = codes[int(n[:k].sum()) :][: n[k]]
            out[some[k]] = _alone(pieces.lattice(own, n[k : k + 1]), int(n[k]), log_p)[-1]
    return out


def expected_counts(words: list[str], language: np.ndarray, times: np.ndarray, log_p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """(piece, language): how often pieces are expected in words, each with its language's number
    and its count, by forward and backward sums."""
    n_languages = log_p.shape[1]
    out = np.zeros(log_p.size)
    flat = np.exp(log_p + pieces.factor[:, None]).ravel()

    def alone(codes: np.ndarray, own: int, count: float):
        lattice, n = pieces.lattice(codes, np.array([len(codes)])), len(codes)
        p = log_p[:, [own]]
        a, b = _alone(lattice, n, p)[:, 0], _alone(lattice, n, p, True)[:, 0]
        share = np.exp(a[lattice.end - lattice.length] + p[lattice.piece, 0] + b[lattice.end] - a[-1])
        np.add.at(out, lattice.piece * n_languages + own, share * count)

    for some, codes, n in pieces.chunks(words):
        own, count = language[some], times[some]
        if n[-1] > LONG:
            alone(codes, int(own[0]), float(count[0]))
            continue
        lattice = pieces.lattice(codes, n)
        groups = lattice.groups()
        place = lattice.piece * n_languages + own[lattice.word]
        p = flat[place]
        a = np.zeros((int(n[-1]) + 1, len(n)))
        b = a.copy()
        a[0], b[n, np.arange(len(n))] = 1, 1
        for end, length, edges in groups:
            word = lattice.word[edges]
            a[end, word] += a[end - length, word] * p[edges]
        for end, length, edges in sorted(groups, key=lambda g: -g[0]):
            word = lattice.word[edges]
            b[end - length, word] += b[end, word] * p[edges]
        low = b[0] < LEAST
        weight = np.where(low, 0, count / np.where(low, 1, b[0]))
        word = lattice.word
        out += np.bincount(place, a[lattice.end - lattice.length, word] * p * b[lattice.end, word] * weight[word], log_p.size)
        for k in np.flatnonzero(low).tolist():
            alone(codes[int(n[:k].sum()) :][: n[k]], int(own[k]), float(count[k]))
    return out.reshape(log_p.shape)


class _Letters(dict):
    """What becomes of a code point: letters and marks stay, all others are blanks."""

    def __missing__(self, code: int) -> int:
        self[code] = found = code if unicodedata.category(chr(code))[0] in "LM" else 32
        return found


_letters = _Letters()


def words_of(text: str | None) -> list[str]:
    """The words of a text, runs of letters and marks in lower case; none where no letter is."""
    words = (text or "").lower().translate(_letters).split()
    return words if any(c.isalpha() for w in words for c in w) else []


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the words of docs(lang, text)."""

    def run(batches):
        held = {}

        def flush():
            for lang, count in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > COUNTED:
                yield from flush()
        yield from flush()

    counted = map_batches(docs.select("lang", "text"), run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """The learned languages in order, the log of their shares of documents, and (piece, language)
    log probabilities."""

    names: list[str]
    log_share: np.ndarray
    log_p: np.ndarray


def maximised(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts (piece, language): a language's few counts are
    filled up as all languages together have them."""
    together = counts.sum(1) + FLAT / len(counts)
    filled = counts + PRIOR * (together / together.sum())[:, None]
    return np.log(filled) - np.log(filled.sum(0))


def learn(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Languages | None:
    """Models of all languages of docs(doc_id, lang, text) outside the held-out fold; None where
    no such row has a language and a text. Rows without id are not learned from."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), "text").dropna()
    known = known.where(fold(F.col("doc_id")) != 1)
    shares = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not shares:
        return None
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(r["lang"] for r in shares)
    share = np.array([{r["lang"]: r["count"] for r in shares}[x] for x in names], float)
    words = stored(word_counts(known), "words")
    number = {x: i for i, x in enumerate(names)}
    log_p = np.full((_pieces(vocabulary).n, len(names)), -np.log(_pieces(vocabulary).n))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(log_p)

        def run(batches, sent=sent):
            pieces = _pieces(vocabulary)
            total = np.zeros(sent.value.shape)
            for batch in batches:
                lang, word, n = batch.columns
                own = np.fromiter(map(number.__getitem__, lang.to_pylist()), np.int64, batch.num_rows)
                total += expected_counts(word.to_pylist(), own, n.to_numpy().astype(float), sent.value, pieces)
            piece, own = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(own), pa.array(total[piece, own])], names=["piece", "own", "n"]
            )

        # a row for each piece and language at most
        found = map_batches(words, run, "piece long, own long, n double").groupBy("piece", "own").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(log_p.shape)
        counts[found["piece"].to_numpy(int), found["own"].to_numpy(int)] = found["n"]
        log_p = maximised(np.round(counts, 6))  # sums come in any order
        sent.unpersist()
    discard(words)
    return Languages(names, np.log(share / share.sum()), log_p)


class Scorer:
    """Scores of words by one model, those met before being kept up to a bound."""

    def __init__(self, model: Languages, vocabulary: str):
        self.model, self.pieces = model, _pieces(vocabulary)
        self.most = max(10_000, KEPT_BYTES // (8 * len(model.names) + 160))
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.names)))

    def texts(self, words: list[list[str]]) -> np.ndarray:
        """(text, language): log probabilities of texts given as words."""
        new = list({w for some in words for w in some if w not in self.place})
        if new:
            if len(self.place) + len(new) > self.most:
                self.place, self.scores = {}, self.scores[:0]
                new = list({w for some in words for w in some})
            self.place |= zip(new, range(len(self.place), len(self.place) + len(new)))
            self.scores = np.concatenate([self.scores, word_scores(new, self.model.log_p, self.pieces)])
        out = np.tile(self.model.log_share, (len(words), 1))
        for row, some in zip(out, words):
            row += self.scores[np.fromiter(map(self.place.__getitem__, some), np.int64, len(some))].sum(0)
        return out


def predict_languages(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, lang, text): the language
    with the greatest probability given the text, and that probability.

    A null text, one without letters, and every text where no language was learned have `und` and score 0. Of
    equally likely languages the least name counts. Rows without id are never held out and not
    learned from; repeated rows and equal ids come back as given; an empty table gives none;
    other columns are not read. Very long words are summed up like others, one by one. What
    is sent to all tasks is a number for each piece of the vocabulary and language, of which there
    are MOST_LANGUAGES at most.
    """
    vocabulary = vocabulary or vocabulary_path("piece_bpe_32k.model")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, vocabulary, rounds))
    scorers = {}

    def run(columns):
        ids, texts = columns
        if "one" not in scorers:
            scorers["one"] = model.value and Scorer(model.value, vocabulary)
        scorer = scorers["one"]
        names, scores = ["und"] * len(ids), np.zeros(len(ids))
        words = [words_of(t) if scorer else [] for t in texts]
        if some := [k for k, w in enumerate(words) if w]:
            logs = scorer.texts([words[k] for k in some])
            best = logs.argmax(1)
            for k, b in zip(some, best.tolist()):
                names[k] = scorer.model.names[b]
            scores[some] = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = by_text(keyed, ["doc_id", "text"], "doc_id long, lang_pred string, score double", run, scorers.clear)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")
