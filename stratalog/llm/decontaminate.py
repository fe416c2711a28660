"""Benchmark passages in documents, by an FM-index over each shard of training text.

A shard is a block of a task's documents. Its words become symbols of the benchmark's
vocabulary; a word outside it can be in no phrase, so it ends a run, and runs shorter than
the shortest phrase hold none. The runs are indexed (suffix array, Burrows-Wheeler transform,
wavelet matrix), all phrases are searched backwards at once, occurrences are located by
sampled suffix positions, and hit words are merged into spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import discard, free_name, keeps_columns, map_batches, stored

#: Words of a window, share of hit words that contaminates, words of a shard's index, suffix
#: sampling step, and benchmark bytes that one broadcast block may hold.
WINDOW, SHARE, SHARD_WORDS, SAMPLE, BLOCK_BYTES = 13, 20, 2_000_000, 8, 8_000_000

#: A word before A-Z become lower case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of words stay, A-Z become lower case, all else separates; bytes of non-ASCII
#: characters are bytes of words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Phrases:
    """The windows of a block of benchmark items, as right-aligned rows of symbols."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        at = {item: k for k, item in enumerate(self.items)}
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(ids):
                ids = np.concatenate([np.zeros(max(0, window - len(ids)), np.int32), ids])
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owner.append(np.full(len(rows[-1]), at[item]))
        flat = np.concatenate(rows)
        # equal rows become one, by their bytes
        flat, back = np.unique(flat.view(np.dtype((np.void, 4 * window))).ravel(), return_inverse=True)
        self.symbols = flat.view(np.int32).reshape(-1, window)
        self.lengths = (self.symbols > 0).sum(1)
        owned = np.unique(back * len(self.items) + np.concatenate(owner))
        self.owner = owned % max(1, len(self.items))
        self.owner_start = np.searchsorted(owned, np.arange(len(flat) + 1) * len(self.items))
        self.shortest = int(self.lengths.min()) if len(flat) else 0

    def owners(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in windows, item) for every item of each window."""
        n = self.owner_start[windows + 1] - self.owner_start[windows]
        row = np.repeat(np.arange(len(windows)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self.owner[self.owner_start[windows][row] + within]


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix sums per bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for k in reversed(range(bits)):
            bit = (seq >> k & 1).astype(np.int32)
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(seq) - int(self.levels[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        start, end = np.zeros_like(at), at
        for k, ones, zeros in zip(reversed(range(self.bits)), self.levels, self.zeros):
            bit = symbol >> k & 1
            a, b = ones[start], ones[end]
            start, end = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, end - b)
        return end - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of seq by prefix doubling; separators (0) compare by position."""
    n = len(seq)
    stops = seq == 0
    rank = seq + int(stops.sum())
    rank[stops] = np.arange(int(stops.sum()))
    step, order = 0, None
    while True:
        if step:
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            key = rank * (n + len(seq) + int(seq.max(initial=0)) + 2) + after
        else:
            key = rank
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step = step * 2 or 1


class FMIndex:
    """Backward search and location of symbol rows in a sequence whose runs end in 0."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        order = suffix_array(seq)
        before = seq[order - 1]  # the first suffix is preceded by the last symbol, a separator
        self.wavelet = WaveletMatrix(before, max(1, int(n_symbols).bit_length()))
        self.before = before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))]).astype(np.int64)
        kept = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.where(kept, order, -1)

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, from, to): suffix ranges of the rows that occur. Rows are right-aligned."""
        row = np.arange(len(symbols))
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), len(self.before), np.int64)
        for k in reversed(range(symbols.shape[1])):
            symbol = symbols[row, k]
            on = symbol > 0
            if on.any():
                s = symbol[on]
                both = self.wavelet.rank(np.concatenate([s, s]), np.concatenate([low[on], high[on]]))
                low[on], high[on] = self.first[s] + both[: len(s)], self.first[s] + both[len(s) :]
                some = low < high
                row, low, high = row[some], low[some], high[some]
            if not len(row):
                break
        return row, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in low, place in the sequence) of every occurrence, by walking back to a
        sampled suffix."""
        n = high - low
        which = np.repeat(np.arange(len(low)), n)
        at = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        place, steps, todo = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(todo):
            found = self.sampled[at[todo]]
            done = found >= 0
            place[todo[done]] = found[done] + steps
            todo = todo[~done]
            symbol = self.before[at[todo]]
            at[todo] = self.first[symbol] + self.wavelet.rank(symbol, at[todo])
            steps += 1
        return which, place


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, word place) of the runs of known words that can hold a phrase, each run
    ended by a 0."""
    known = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    fits = end - start >= shortest
    start, end = start[fits], end[fits]
    length = end - start + 1  # with its separator
    place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    seq = ids[np.minimum(place, len(ids) - 1)].astype(np.int64)
    seq[np.cumsum(length) - 1] = 0
    return seq, place


def scan_shard(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
    """Per document: its number of words, a mask of the hit ones, the items with an occurring
    window."""
    get = phrases.vocabulary.get
    ids = []
    for t in texts:
        w = words(t)
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
    n = [len(i) for i in ids]
    start = np.concatenate([[0], np.cumsum([x + 1 for x in n])]).astype(np.int64)
    items: list[list[str]] = [[] for _ in texts]
    hit = np.zeros(int(start[-1]) + 1, np.int64)
    if phrases.shortest:
        flat = np.zeros(int(start[-1]), np.int32)  # a 0 between documents
        for a, i in zip(start, ids):
            flat[a : a + len(i)] = i
        seq, place = _runs(flat, phrases.shortest)
        if len(seq):
            index = FMIndex(seq, len(phrases.vocabulary))
            row, low, high = index.search(phrases.symbols)
            which, at = index.locate(low, high)
            window, at = row[which], place[at]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + phrases.lengths[window], -1)
            doc = np.searchsorted(start, at, side="right") - 1
            seen, item = phrases.owners(window)
            for pair in np.unique(doc[seen] * len(phrases.items) + item).tolist():
                d, i = divmod(pair, len(phrases.items))
                items[d].append(phrases.items[i])
    covered = np.cumsum(hit) > 0
    return n, [covered[a : a + k] for a, k in zip(start, n)], items


def removal_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of hit words, from the first to the last of each run."""
    if not mask.any():
        return []
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(found[a][0], found[b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]


class Block:
    """The items of a block, as they are broadcast; a Python worker makes phrases of them once."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items, self.window = items, window

    def __getstate__(self):
        return {"items": self.items, "window": self.window}

    @cached_property
    def phrases(self) -> Phrases:
        return Phrases(self.items, self.window)


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of at most about block_bytes, one at a time.

    A benchmark is a stated query set; its size is measured before anything is collected.
    Rows without item_id or text have no windows.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).dropna().distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Block(sorted((r[0], r[1]) for r in part.toLocalIterator()), window)


def _shards(batches, text_at: int):
    """Slices of the incoming batches with about SHARD_WORDS words each."""
    for batch in batches:
        size, start = 0, 0
        lengths = [len(t.as_py() or "") if t.is_valid else 0 for t in batch.column(text_at)]
        for i, k in enumerate(lengths):
            size += k
            if size >= 6 * SHARD_WORDS:
                yield batch.slice(start, i + 1 - start)
                size, start = 0, i + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def mark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with three more columns, by one narrow pass for each block of the benchmark: the
    number of words, the hit ones (a bit per word, null for none), and the items. Between two
    passes lies a table, so that neither the driver nor a task holds two blocks."""
    spark = docs.sparkSession
    out = docs.withColumns(
        {
            free_name(docs, "n_words"): F.lit(0).cast("long"),
            free_name(docs, "hit"): F.lit(None).cast("binary"),
            free_name(docs, "items"): F.array().cast("array<string>"),
        }
    )
    names = out.columns
    text_at = names.index("text")
    shared, passed = None, None
    for block in phrase_blocks(benchmark, window, block_bytes):
        if shared:
            out = stored(out, "marked")
            shared.destroy()
            if passed:
                discard(passed)
            passed = out
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for shard in _shards(batches, text_at):
                n, masks, items = scan_shard(shard.column(text_at).to_pylist(), shared.value.phrases)
                before, had = shard.column(len(names) - 2).to_pylist(), shard.column(len(names) - 1).to_pylist()
                bits = []
                for mask, old in zip(masks, before):
                    if old is not None:
                        mask = mask | np.unpackbits(np.frombuffer(old, np.uint8), count=len(mask)).astype(bool)
                    bits.append(np.packbits(mask).tobytes() if mask.any() else None)
                items = [sorted({*a, *b}) for a, b in zip(had, items)]
                yield pa.RecordBatch.from_arrays(
                    [*shard.columns[:-3], pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    names=names,
                )

        out = map_batches(out, run, out.schema)
    return out


def _judged(df: DataFrame, n_hit) -> DataFrame:
    return df.withColumn("contaminated", (n_hit > 0) & (F.lit(SHARE) * n_hit >= F.col("n_words")))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of docs(doc_id, text): words, hit words, items, and the verdict.

    Null and empty texts have no words and are clean; items of fewer words than the window
    are one window, items without words none; an empty benchmark or table gives clean rows
    or none. Repeated rows and ids come back as given, equal item ids count once; other
    columns are not read.
    """

    def count(batches):
        for batch in batches:
            ids, n, bits, items = batch.columns
            hits = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in bits.to_pylist()]
            names = [",".join(i) for i in items.to_pylist()]
            digests = [hashlib.sha256(s.encode()).hexdigest() for s in names]
            counts = [len(i) for i in items.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, n, pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    marked = mark_hits(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_bytes)
    counted = map_batches(
        marked.drop("text"), count, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
    )
    return _judged(counted, F.col("n_hit"))


@keeps_columns
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones; where fewer words are hit, without their spans.

    All columns are kept; text is cut and n_chars, where there is one, follows. Null and empty
    texts stay as they are, and so do all rows where the benchmark is empty. Repeated rows and
    ids are judged row by row; an empty table gives none.
    """
    names, text_at = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in batches:
            columns = list(batch.columns)
            n, bits = columns[-3].to_pylist(), columns[-2].to_pylist()
            texts, keep = columns[text_at].to_pylist(), []
            for i, (k, b) in enumerate(zip(n, bits)):
                mask = np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) if b else None
                n_hit = int(mask.sum()) if b else 0
                keep.append(not (n_hit > 0 and SHARE * n_hit >= k))
                if n_hit and keep[-1]:
                    parts, at = [], 0
                    for a, z in removal_spans(texts[i], mask):
                        parts.append(texts[i][at:a])
                        at = z
                    texts[i] = "".join([*parts, texts[i][at:]])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns[:-3], names=names).filter(pa.array(keep))

    out = map_batches(mark_hits(docs, benchmark, window), cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
