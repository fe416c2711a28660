"""Token ids of texts by white-space chunks, with a bounded cache of chunks per worker."""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np

#: Chunks in each of a cache's two generations, and bytes of a chunk worth keeping.
CACHE_CHUNKS, CACHE_BYTES = 250_000, 64


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of a vocabulary file and of the library version that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


#: Chunks whose pieces need no normaliser but lower case: printable ASCII without the
#: apostrophe, and Latin-1 letters. Their pieces are runs of letters, single digits, and runs
#: of anything else.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]{1,200}")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 ones
    as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _plain_encoder(path: str):
    """The same merges for plain pieces, each ended by a NUL that stands for the word end.

    Ids are merge ranks here (checked), so the merge order is that of the library.
    """
    import tiktoken

    with open(path, "rb") as f:
        model = json.load(f)["model"]
    vocab, end, letters = model["vocab"], model.get("end_of_word_suffix"), _byte_alphabet()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if not end or any(vocab["".join(m)] != 512 + i for i, m in enumerate(merges)):
        return None
    ranks = {}
    for token, i in vocab.items():
        ended = token.endswith(end)
        body = token[: -len(end)] if ended else token
        if all(c in letters for c in body):
            ranks[bytes(letters[c] for c in body) + b"\0" * ended] = i
    encoding = tiktoken.Encoding("plain", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for b, i in ranks.items() if b.endswith(b"\0") and len(b) > 1]] = True
    return encoding, ends


class ChunkTokenizer:
    """Ids of a text as the library gives them, without special tokens being added.

    The tokenizer's pieces never hold white space, its normaliser never joins characters
    over an ASCII space, and its special strings hold none: so the ids of a text are those
    of its ASCII-white-space-delimited chunks in a row, and chunks can be cached. Chunks
    that are not in the cache go to the library in one call; plain ones are merged by the
    same ranks in a faster library, with equal results.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = _plain_encoder(path)
        self.ids: dict[bytes, bytes] = {}  # lately used chunks
        self.older: dict[bytes, bytes] = {}  # those of the generation before

    def _merged(self, chunks: list[bytes], texts: list[str]) -> dict[bytes, bytes]:
        if not chunks:
            return {}
        encoding, ends = self.plain
        pieces = [_PIECE.findall(t.lower()) for t in texts]
        joined = "\0".join(p for some in pieces for p in some) + "\0"
        ids = np.array(encoding.encode_ordinary(joined), "<u4")
        last = np.flatnonzero(ends[ids])[np.cumsum([len(p) for p in pieces]) - 1] + 1
        raw, cuts = ids.tobytes(), [0, *(4 * last).tolist()]
        return {c: raw[a:b] for c, a, b in zip(chunks, cuts, cuts[1:])}

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        texts = [c.decode("utf-8", "replace") for c in new]
        easy = [self.plain is not None and _PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        found = self._merged([c for c, e in zip(new, easy) if e], [t for t, e in zip(texts, easy) if e])
        hard = [t for t, e in zip(texts, easy) if not e]
        got = self.tokenizer.encode_batch_fast(hard, add_special_tokens=False) if hard else []
        found |= {c: np.array(g.ids, "<u4").tobytes() for c, g in zip([c for c, e in zip(new, easy) if not e], got)}
        return found

    def _keep(self, found: dict[bytes, bytes]) -> None:
        """Add to the cache. A full generation becomes the older one, whose chunks come back
        when they are met again: frequent ones stay."""
        if len(self.ids) + len(found) > CACHE_CHUNKS:
            self.ids, self.older = {}, self.ids
        self.ids.update((c, i) for c, i in found.items() if len(c) <= CACHE_BYTES)

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit numbers."""
        chunks = text.encode("utf-8", "replace").split()
        parts = list(map(self.ids.get, chunks))
        if None in parts:
            missed = {c for c, p in zip(chunks, parts) if p is None}
            found = {c: p for c in missed if (p := self.older.get(c)) is not None}
            if len(found) < len(missed):
                found |= self._learn([c for c in missed if c not in found])
            parts = [found[c] if p is None else p for c, p in zip(chunks, parts)]
            self._keep(found)
        return b"".join(parts)

    def forget(self) -> None:
        """Empty the cache: a worker that lives on has other work to do."""
        self.ids, self.older = {}, {}

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


_made: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per Python worker and path; workers are used again by later tasks."""
    if path not in _made:
        _made[path] = ChunkTokenizer(path)
    return _made[path]
