"""Secrets in texts: known shapes, and strings that stay novel beside what surrounds them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalog.llm.common import by_text

KINDS = ("assign", "access", "hex", "novel")

# The shapes of plain secrets.
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters of a line that may stand between a sensitive word and what it makes sensitive,
#: characters that may stand between a reported string and the one directly after it, and
#: strings in a row that may be unreported in a list of which each string directly follows another.
NEAR, BETWEEN, MISSES = 40, 80, 8

# Words that make a place sensitive, and identifiers that code is full of.
_SENSITIVE = re.compile(
    r"(?ai:key|secret|token|passw|pwd|auth|credential|private|bearer|signature|session|cookie)[^\n]{0,%d}$" % NEAR
)
_SENSITIVE_HINT = re.compile(rb"key|secret|token|passw|pwd|auth|credential|private|bearer|signature|session|cookie")
_IDENTIFIERS = (
    b"return import from class function def const static public private protected void string boolean integer "
    b"float double self this None null true false undefined async await export default require module config "
    b"environment variable localhost http https www index length value values key keys item items name names "
    b"user users client server request response header headers body content type status error message code "
    b"application/json text/html charset=utf-8 Content-Type Authorization Bearer username email address "
    b"getElementById querySelector addEventListener document window console.log print format join split "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_api_key_here changeme example "
    b"xxxxxxxxxxxxxxxx ---------------- ================ ________________ ................ 0000000000000000"
)
#: Runs of printable characters between blanks and quotes, and the strings of key alphabets in
#: them. A run of which these are less than KEY_SHARE is judged whole first.
_RUN = re.compile(r"[!#-&(-_a-~]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_EDGE, KEY_SHARE = "()[]{}<>,;.:|", 0.8
_NO_KEY = frozenset(string.punctuation) - frozenset("+/_=-")
#: What may stand between a string and the one that directly follows it, and the short last
#: line of a key.
_BETWEEN = re.compile(r"(?:\\[nr]|[\s\"'`\\+.,:;|>#*]){0,%d}" % BETWEEN)
_LAST_LINE = re.compile(r"\s{1,%d}([A-Za-z0-9+/=]{1,15})\s{1,%d}-----END" % (BETWEEN, BETWEEN))

#: Characters on each side that count as surroundings, and the least marginal bytes per
#: character of a string that is reported: LEAST_NOVELTY, or this share of what random text
#: of its alphabet and length costs, if two of its characters are equal at most so many times
#: as often as there.
CONTEXT_CHARS, LEAST_NOVELTY, RANDOM_SHARE, MOST_UNEVEN = 512, 0.8, 0.9, 1.35


def plain_secrets(text: str, low: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain shapes. low: the text's UTF-8 in ASCII lower case."""
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if b"akia" in low:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes per character of candidate, by a compressor primed with the
    identifier dictionary and the surrounding text."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(
        _IDENTIFIERS + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    compressor = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False)
    raw = candidate.encode()
    return (len(compressor.compress(raw)) - len(compressor.compress(b""))) / len(raw)


def alphabet(s: str) -> str:
    """The characters that s seems drawn from: its classes, letters being hexadecimal ones
    and digits those of base32 if s has no others. Classes with hardly a character are left
    out, so that a prefix or padding does not count."""
    found = ""
    for some in ("abcdef", "ABCDEF", "234567", "+/", "-_"):
        full = next((c for c in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if some[0] in c), some)
        own = [c for c in s if c in full]
        if 16 * len(own) > len(s):
            found += some if set(own) <= set(some) else full
    odd = [c for c in s if c in _NO_KEY]
    if 16 * len(odd) > len(s):
        found += "".join(sorted(set(odd)))
    return found or string.ascii_letters + string.digits


@lru_cache(4096)
def random_novelty(letters: str, n: int) -> float:
    """novelty of random text of n characters."""
    return novelty("".join(random.Random(n).choices(letters, k=n)), "")


def is_novel(s: str, around: str) -> bool:
    """Whether s costs as many bytes as a secret. Words cost nearly as many as random text of
    their letters, but have some letters much more often."""
    cost = novelty(s, around)
    if cost >= LEAST_NOVELTY:
        return True
    letters = alphabet(s)
    unit = 1 if len(s) < 64 else max(32, 1 << (len(s).bit_length() - 6))  # lengths that differ by less cost alike
    n = -(-len(s) // unit) * unit
    if cost < RANDOM_SHARE * random_novelty(letters, n):
        return False
    counts = [s.count(c) for c in letters]
    total = sum(counts)
    return len(letters) * sum(k * (k - 1) for k in counts) <= MOST_UNEVEN * total * (total - 1)


@lru_cache(1)
def _letter_odds() -> dict[str, float]:
    """Log of how many times as often a letter stands in identifiers as in random text."""
    read = [chr(c) for c in _IDENTIFIERS.lower() if chr(c).isalpha()]
    return {c: math.log((read.count(c) + 1) * 26 / (len(read) + 26)) for c in string.ascii_lowercase}


def is_mixed(s: str) -> bool:
    """Whether s is no word, path or piece of code: its letters are not those that words have. Of
    text with few letters, whether it has many different characters."""
    odds = [_letter_odds()[c] for c in s.lower() if c in string.ascii_letters]
    return sum(odds) < 0 if len(odds) >= 8 else len(set(s)) >= 8


def _parts(text: str, start: int, end: int, judge) -> list[tuple[int, int]]:
    """The bounds of what judge reports in a run: all of it, or else strings in it."""
    run, strings = text[start:end], list(_CANDIDATE.finditer(text, start, end))
    if sum(m.end() - m.start() for m in strings) < KEY_SHARE * len(run):
        a, b = start + len(run) - len(run.lstrip(_EDGE)), start + len(run.rstrip(_EDGE))
        if b - a >= 16 and is_mixed(text[a:b]) and judge(a, b):
            return [(a, b)]
    found = []
    for m in strings:
        s = m.group()
        if (any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or is_mixed(s)) and judge(*m.span()):
            found.append(m.span())
    return found


def novel_secrets(text: str, low: bytes, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings after a sensitive word, or directly after a string reported there, that their
    surroundings do not explain. A string that a plain span covers is not reported again; one
    that has plain spans in it is, whole, if it or what is left of it without them is novel."""
    if not _SENSITIVE_HINT.search(low):
        return []
    found = []
    taken = sorted((a, b) for _, a, b in plain)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    ends, at = sorted(b for k, _, b in plain if k == "assign"), 0
    before, missed = -1, 0  # where the list ends that a string may follow

    def covered(a: int, b: int) -> bool:
        k = bisect_right(starts, a)
        return k > 0 and reach[k - 1] >= b

    def without(a: int, b: int) -> str:
        """text[a:b] without the plain spans that end in it."""
        out, at = [], a
        for x, y in taken[max(0, bisect_right(starts, a) - 1) : bisect_right(starts, b - 1)]:
            if y > at:
                out.append(text[at : max(at, x)])
                at = y
        return "".join(out) + text[at:b]

    def in_list(a: int) -> bool:
        return before >= 0 and a - before <= BETWEEN and bool(_BETWEEN.fullmatch(text, before, a))

    def judge(a: int, b: int) -> bool:
        if covered(a, b) or not (in_list(a) or _SENSITIVE.search(text, max(0, a - NEAR - 24), a)):
            return False
        around = text[max(0, a - CONTEXT_CHARS) : a] + "\n" + text[b : b + CONTEXT_CHARS]
        rest = without(a, b)
        if 0 < len(rest) < 16 and len(rest) + 24 <= b - a:  # what is left at the ends of plain secrets
            return True
        return is_novel(text[a:b], around) or 16 <= len(rest) < b - a and is_novel(rest, around)

    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(ends) and ends[at] <= start:
            before, missed = max(before, ends[at]), 0
            at += 1
        follows = in_list(start)
        parts = _parts(text, start, end, judge)
        found += [("novel", a, b) for a, b in parts]
        if parts:
            before, missed = parts[-1][1], 0
            if tail := _LAST_LINE.match(text, before):
                found.append(("novel", tail.start(1), tail.end(1)))
        elif follows and (covered(start, end) or missed < MISSES):
            before, missed = end, 0 if covered(start, end) else missed + 1
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts of plain secrets, their digest, all spans.

    Null texts are empty ones; an empty text has no spans and the digest of the empty
    string. Repeated rows and null ids come back as given; other columns are not read. Only
    runs of 16 printable characters or more, without blanks and quotes, in a sensitive place are
    compressed, each against at most CONTEXT_CHARS on either side; of those in a list, up to
    MISSES in a row may be unreported before the list ends. Letters that read like words and
    text beyond ASCII are not reported. No shuffle.
    """

    def scan(columns):
        ids, texts = columns
        rows = []
        for text in texts:
            text = text or ""
            low = text.encode("utf-8", "replace").lower()
            plain = plain_secrets(text, low)
            base = _joined(plain)
            n = [sum(s[0] == k for s in plain) for k in KINDS[:3]]
            rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), _joined(plain + novel_secrets(text, low, plain))))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return by_text(docs, ["doc_id", "text"], _SCHEMA, scan)
