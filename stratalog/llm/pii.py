"""Personal data in texts, disguised or not, with spans in characters of the source text.

Plain identifiers are found on the text itself. Three transducers (homoglyphs, spelled
digits, at/dot disguises) then rewrite the text while they keep, for each character of the
result, the source characters it stands for; identifiers found there that hold a rewritten
character are mapped back and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalog.llm.common import by_text

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# The shapes of plain identifiers.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# a run of digits is entered once, at its start, so that a long one costs its length
_DOTTED = re.compile(r"(?<![0-9])[0-9]++\.[0-9.]+")
_GROUP = re.compile(r"[0-9]+")
#: What every ip has; its first character is found fast.
_IP_TAIL = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]")


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(Span("email", start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _ips(text: str) -> list[Span]:
    """Four digit groups with single dots between them: each run of digits and dots is cut
    into groups once, so a long run costs its length."""
    if not _IP_TAIL.search(text):
        return []
    found = []
    for run in _DOTTED.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        i = 0
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            gap = next((k for k in (2, 1, 0) if four[k + 1][0] - four[k][1] != 1), None)
            if gap is not None:
                i += gap + 1
                continue
            if all(_small(text[a:b]) for a, b in four):
                found.append(Span("ip", four[0][0], four[3][1]))
            i += 4
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(Span("card", m.start(), m.end()))
    return found


def _phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [
        Span("phone", m.start(), m.end())
        for m in _PHONE.finditer(text)
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15
    ]


def plain_spans(text: str) -> list[Span]:
    """The undisguised identifiers, by kind and then start."""
    return _emails(text) + _ips(text) + _cards(text) + _phones(text)


# Letters that look like ASCII ones, spelled digits, and disguises.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ո": "n", "һ": "h", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_ZERO_WIDTH = "​‌‍⁠﻿­"
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}


def _homoglyph_table() -> dict[int, str]:
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    table |= {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}  # full-width forms
    for c in range(0x80, 0x1FBFA):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = str(d)
        elif 0x1D400 <= c < 0x1D7CE and (n := unicodedata.normalize("NFKC", chr(c))).isascii() and len(n) == 1:
            table[c] = n
    return table | {ord(c): "" for c in _ZERO_WIDTH}


_TABLE = _homoglyph_table()
#: UTF-8 lead bytes below which no character of the table starts, and those of the few above.
_ODD = re.compile(rb"\xc2[\xa0\xad]|\xc4\xb1|[\xcd-\xf4]")
_WORD = "(?:" + "|".join(_DIGITS) + ")"
_SPELLED = re.compile(rf"(?<![a-z])(?:plus[\s-]+)?{_WORD}(?:[\s,.-]{{1,3}}{_WORD}|[\s-]?[0-9])*(?![a-z])", re.I | re.A)
_ONE_WORD = re.compile(rf"(plus)|({_WORD})|([\s,.-]+)", re.I | re.A)
# each blank run is entered once, at its start, so that a long one costs its length
_AT = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(?:at|@)\s*[\])}>]\s*|(?<!\s)\s+at\s+(?=[a-z0-9-]+(?:\s*(?:[\[({<]\s*)?\b(?:dot|point)\b|\.[a-z0-9]))", re.I | re.A)
_DOT = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(?:dot|point|\.)\s*[\])}>]\s*|(?<=[a-z0-9-])\s+(?:dot|point)\s+(?=[a-z0-9])", re.I | re.A)
_AT_HINT = re.compile(r"\sat\s|[\[({<]\s*(?:at|@)\s*[\])}>]", re.I | re.A)
_DOT_HINT = re.compile(r"\s(?:dot|point)\s|[\[({<]\s*(?:dot|point|\.)\s*[\])}>]", re.I | re.A)


class Mapped:
    """A rewritten text, with the source start and end that each of its characters covers."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)
        self.changed: list[bool] = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace each [start, end) by its text; edits are in order and do not overlap. A
        character put in stands for the whole stretch that it replaces; one that replaces
        nothing visible leaves a mark on the character after it."""
        if not edits:
            return
        parts, starts, ends, changed, at, mark = [], [], [], [], 0, False
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += (self.text[at:a], new)
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            kept = list(self.changed[at:a])
            if mark and kept:
                kept[0], mark = True, False
            changed += kept
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
                changed += [True] * len(new)
            mark = mark or (b > a and not new)
            at = b
        self.text, self.starts, self.ends, self.changed = "".join(parts), starts, ends, changed


def _may_spell(text: str) -> bool:
    """Whether a digit's name begins somewhere where no letter a-z stands before it: no run of
    spelled digits is without."""
    low = text.lower()
    if "\u212a" in text:  # its lower case is k, which it is not
        return True
    for name in _DIGITS:
        at = low.find(name)
        while at >= 0:
            if not (at and "a" <= low[at - 1] <= "z"):
                return True
            at = low.find(name, at + 1)
    return False


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits become digits; what separates them goes, except a lone dot."""
    edits = []
    for m in _SPELLED.finditer(text):
        for w in _ONE_WORD.finditer(text, m.start(), m.end()):
            if w[1]:
                edits.append((w.start(), w.end(), "+"))
            elif w[2]:
                edits.append((w.start(), w.end(), _DIGITS[w[2].lower()]))
            elif "." not in w[3]:
                edits.append((w.start(), w.end(), ""))
    return edits


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show only after normalisation, as spans of the source text."""
    mapped = Mapped(text)
    if not text.isascii() and _ODD.search(text.encode("utf-8", "replace").lower()):
        mapped.rewrite([(i, i + 1, _TABLE[ord(c)]) for i, c in enumerate(text) if ord(c) in _TABLE])
    # each transducer runs where its own pattern is found, whatever else the text has
    if _may_spell(mapped.text):
        mapped.rewrite(_spelled_edits(mapped.text))
    if _AT_HINT.search(mapped.text):
        mapped.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(mapped.text)])
    if _DOT_HINT.search(mapped.text):
        mapped.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(mapped.text)])
    if not any(mapped.changed):
        return []
    have, found = set(plain), []
    for kind, a, b in plain_spans(mapped.text):
        if any(mapped.changed[a:b]):
            s = Span(kind, mapped.starts[a], mapped.ends[b - 1])
            if s not in have:
                have.add(s)
                found.append(s)
    return found


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


_DETECT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def detect_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts of plain identifiers, their digest, all spans.

    Null texts are empty ones; an empty text has no spans and the digest of the empty
    string. Repeated rows and null ids come back as given; other columns are not read. A
    text is scanned whole and in time proportional to its length. No shuffle.
    """

    def detect(columns):
        ids, texts = columns
        rows = []
        for text in texts:
            text = text or ""
            plain = plain_spans(text)
            n = [sum(s.kind == k for s in plain) for k in KINDS]
            digest = hashlib.sha256(_joined(plain).encode()).hexdigest()
            rows.append((*n, digest, _joined(plain + disguised_spans(text, plain))))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5])],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    return by_text(docs, ["doc_id", "text"], _DETECT, detect)
