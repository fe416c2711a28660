"""Periodic runs of words in texts, and texts without them.

A run is a stretch of words that repeats with its smallest period, at least three times, and
that neither neighbour extends. Longest Lyndon words are found from every place by a stack
scanned right to left, once under each of two opposite orders of the words; among their
lengths are the periods of all runs, which are then extended to both sides. Suffixes are
compared and stretches extended by binary search over rolling hashes; what a hash finds equal
is compared word by word before it counts.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalog.llm.common import by_text, keeps_columns, map_batches

#: Words of a run at least, and how many times it has its period at least.
LEAST_LENGTH, LEAST_TIMES = 24, 3
#: Words compared one by one before hashes are asked.
DIRECT = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """Common extensions of places of a sequence of small numbers (words).

    Hashes are those of prefixes, by powers of an odd base. A stretch that they find equal is
    compared directly, but for the part that was so compared for the same distance before:
    all comparing of one distance costs one pass over the words.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.plain, self.n = words, words.tolist(), n
        with np.errstate(over="ignore"):
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(words.astype(np.uint64) + _BASE) * self.power[:n])])
        self._power, self._prefix = None, None
        self._known: dict[int, tuple[int, int]] = {}

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of the stretches of length from i and from j > i are equal; false
        where one leaves the sequence."""
        inside = (i >= 0) & (j + length <= self.n)
        i, j, length = (np.where(inside, x, 0) for x in (i, j, length))
        with np.errstate(over="ignore"):
            a = (self.prefix[i + length] - self.prefix[i]) * self.power[j - i]
            return inside & (a == self.prefix[j + length] - self.prefix[j])

    def repeats(self, length: int) -> bool:
        """Whether some stretch of length may stand twice; false is certain."""
        n = self.n - length + 1
        with np.errstate(over="ignore"):
            h = np.sort((self.prefix[length:] - self.prefix[:n]) * self.power[n - 1 :: -1][:n])
        return bool((h[1:] == h[:-1]).any())

    def _same(self, i: int, j: int, length: int) -> bool:
        mask = 0xFFFFFFFFFFFFFFFF
        h = self._prefix
        return ((h[i + length] - h[i]) * self._power[j - i] - h[j + length] + h[j]) & mask == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i on are as those from j > i on."""
        s, most = self.plain, self.n - j
        k = 0
        while k < DIRECT:
            if k == most or s[i + k] != s[j + k]:
                return k
            k += 1
        at, to = self._known.get(j - i, (-1, -1))
        if at <= i + k <= to:
            return to - i
        if self._prefix is None:
            self._prefix, self._power = self.prefix.tolist(), self.power.tolist()
        low, high = k, most + 1  # equal at low, unequal at high
        step = k
        while low + step < high:  # gallop, then halve
            if not self._same(i, j, low + step):
                high = low + step
                break
            low += step
            step *= 2
        while high - low > 1:
            mid = (low + high) // 2
            if self._same(i, j, mid):
                low = mid
            else:
                high = mid
        end = i + low
        if at <= end <= to:  # from at on they were compared before
            end, least = to, min(at, i + low)
        else:
            least = end
        differ = np.flatnonzero(self.words[i:least] != self.words[j : least + j - i])
        if len(differ):  # unequal words with equal hashes
            end = i + int(differ[0])
        self._known[j - i] = (i, end)
        return end - i

    def left(self, i: int, j: int) -> int:
        """How many words before i are as those before j > i."""
        s, most = self.plain, i
        k = 0
        while k < most and k < DIRECT and s[i - 1 - k] == s[j - 1 - k]:
            k += 1
        if k < DIRECT or k == most:
            return k
        if self._prefix is None:
            self._prefix, self._power = self.prefix.tolist(), self.power.tolist()
        low, high = k, most + 1
        while high - low > 1:
            mid = (low + high) // 2
            if self._same(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid
        differ = np.flatnonzero(self.words[i - low : i] != self.words[j - low : j])
        return low - 1 - int(differ[-1]) if len(differ) else low


def lyndon_ends(at: Stretches, descending: bool) -> list[int]:
    """The end of the longest Lyndon word from each place: a stack of such words, scanned right
    to left, in which a word joins those after it while it is less than they are."""
    s, n = at.plain, at.n
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        j, own = i + 1, s[i]
        while j < n:
            other = s[j]
            if own == other:
                k = at.right(i, j)
                if j + k == n:
                    break
                if (s[i + k] < s[j + k]) == descending:
                    break
            elif (own < other) == descending:
                break
            j = ends[j]
        ends[i] = j
    return ends


def find_runs(words: np.ndarray, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> list[Run]:
    """(start, length, period) of all runs of a sequence of small numbers, in order.

    least_times: 2 or more. A run of period p and at least that length has, from each Lyndon
    word of length p in it, half of what it has beyond p on the left or on the right: only
    places whose hashes agree so far are extended. What a run has beyond its first period
    stands twice, so a sequence in which no stretch of so many words does has none.
    """
    if least_times < 2:
        raise ValueError("a run has its period twice at least")
    n, found = len(words), set()
    if n < least_length:
        return []
    stretches, place = Stretches(words), np.arange(n)
    if not stretches.repeats(-(-least_length * (least_times - 1) // least_times)):
        return []
    for descending in (False, True):
        ends = np.array(lyndon_ends(stretches, descending))
        period = ends - place
        half = np.maximum(0, (np.maximum(least_length - period, (least_times - 1) * period) + 1) // 2)
        may = stretches.equal(place, ends, half) | stretches.equal(place - half, ends - half, half)
        last: dict[int, tuple[int, int]] = {}
        for i, p in zip(place[may].tolist(), period[may].tolist()):
            start, end = last.get(p, (0, 0))
            if start <= i and i + p <= end:
                continue  # another Lyndon word of the same run
            start, end = i - stretches.left(i, i + p), i + p + stretches.right(i, i + p)
            last[p] = start, end
            if end - start >= max(least_length, least_times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def split_words(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text, between ASCII blanks, as numbers, and the distinct words by number."""
    number: dict[bytes, int] = {}
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), list(number)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that some run has after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def _joined(words: np.ndarray, distinct: list[bytes]) -> bytes:
    return b" ".join([distinct[k] for k in words.tolist()])


def longest_power(runs: list[Run]) -> Run | None:
    """The run that has its period the most times; of several, that with the least start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def repeat_tail(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """words, or for ids of which crc32 is divisible by 10 these with a periodic tail; start and
    period follow from the id."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not len(words):
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = words.copy()
    out[a:] = words[a + np.arange(n - a) % p]
    return out


_REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def run_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): the number of runs, the run with the most
    repetitions, and digests of all runs and of the words that stay. Texts of every tenth
    document or so, by its id, are given a periodic tail first.

    Null, empty and blank texts have no words and no runs: four nulls and the digests of
    nothing. Rows without id are left as they are. Repeated rows and equal ids come back as given; an
    empty table gives none; other columns are not read. A text is one row, in memory some
    hundred bytes a word; time grows nearly in proportion to it, however it repeats. No
    shuffle.
    """

    def report(columns):
        rows = []
        for doc_id, text in zip(*columns):
            words, distinct = split_words(text)
            words = repeat_tail(words, doc_id)
            runs = find_runs(words)
            start, length, period = longest_power(runs) or (None, None, None)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
            left = _joined(words[kept_words(len(words), runs)] if runs else words, distinct)
            rows.append((
                doc_id, len(runs), start, length, period, 1000 * length // period if period else None,
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
            ))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [f.split()[0] for f in _REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return by_text(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), ["doc_id", "text"], _REPORT, report)


def text_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """(doc_id, start, length, period, words): one row per run of each text of docs(doc_id,
    text), in word numbers from 0; words: its first period, joined by spaces. Texts as in
    run_report, but none is changed."""
    schema = "doc_id long, start long, length long, period long, words string"

    def rows(columns):
        for doc_id, text in zip(*columns):
            words, distinct = split_words(text)
            if found := find_runs(words, least_length, least_times):
                first = [_joined(words[a : a + p], distinct).decode() for a, _, p in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*found)), pa.array(first)],
                    names=["doc_id", "start", "length", "period", "words"],
                )

    return by_text(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), ["doc_id", "text"], schema, rows)


@keeps_columns
def collapse_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """docs with each run of its texts cut to one period; texts with a run have single spaces
    between their words. All columns and rows stay, those without a run as they are."""
    at, schema, names = docs.columns.index("text"), docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                words, distinct = split_words(text)
                if runs := find_runs(words, least_length, least_times):
                    texts[k] = _joined(words[kept_words(len(words), runs)], distinct).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, schema)
