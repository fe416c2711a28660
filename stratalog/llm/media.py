"""Motion-JPEG AVI files as column values: written, indexed, decoded, and cut into clips.

A payload is kept in the format's own unit, the quantised coefficient: 64 bytes are one
8x8 block. Category 8 holds exactly the 256 values of magnitude 128 to 255, so a byte is the
eight amplitude bits of one coefficient, after the one-bit code of a table with that single
symbol. Any baseline decoder reads such frames; nothing is rounded on the way.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import by_text

#: Blocks in a row and at most rows of blocks in a frame of stored payload; frames a second.
COLS, ROWS, FPS = 4, 4, 25
#: Luma histogram bins, and the cut rule: a difference above mean + CUT_STD deviations of the
#: differences of the shot so far, and above CUT_LEAST of the pixels.
BINS, CUT_STD, CUT_LEAST = 16, 2.5, 0.25


def _zigzag() -> np.ndarray:
    """Raster position of each coefficient in zigzag order: by diagonal, in turning direction."""
    order = sorted(
        ((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1])
    )
    return np.array([8 * r + c for r, c in order])


def _inverse_dct() -> np.ndarray:
    """(coefficient in zigzag order) x (pixel) matrix of the two-dimensional inverse DCT."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.kron(one, one)[_zigzag()].astype(np.float32)


_PIXELS = _inverse_dct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(table: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, whose code is the single bit 0."""
    return _segment(0xC4, bytes([table, 1, *[0] * 15, symbol]))


def _frame_header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * COLS, 1) + b"\x01\x11\x00")
        + _one_code(0x00, 8)
        + _one_code(0x10, 8)
        + _segment(0xDD, b"\x00\x01")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def write_avi(payload: bytes) -> bytes:
    """The AVI file that holds payload, a positive multiple of 64 bytes, losslessly."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    rows = min(ROWS, -(-len(samples) // COLS))
    per_frame = rows * COLS
    n_frames = -(-len(samples) // per_frame)
    bits = np.zeros((n_frames * per_frame, 64, 9), np.uint8)
    bits[: len(samples), :, 1:] = np.unpackbits(samples, axis=1).reshape(-1, 64, 8)
    coded = np.packbits(bits.reshape(-1, 576), axis=1).tobytes()
    header = _frame_header(rows)
    restart = [b"\xff" + bytes([0xD0 + i % 8]) for i in range(per_frame - 1)] + [b"\xff\xd9"]
    frames = []
    for f in range(n_frames):
        parts = [header]
        for b in range(per_frame):
            at = 72 * (f * per_frame + b)
            parts += (coded[at : at + 72].replace(b"\xff", b"\xff\x00"), restart[b])
        frames.append(b"".join(parts))
    movi, index, at = [], [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    most, w, h = max(map(len, frames)), 8 * COLS, 8 * rows
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n_frames, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n_frames, most, 0, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + head + info + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


class BadMedia(ValueError):
    """The bytes are not an AVI file of baseline JPEG frames."""


def _chunks(raw: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_index(raw: bytes) -> tuple[float, list[tuple[int, int]], bytes]:
    """(frames a second, byte range of each frame, comment) by the file's index; where it has
    none, by walking its frames."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise BadMedia("no AVI header")
    fps, index, movi, comment, walked = float(FPS), [], None, b"", []
    todo = [(12, min(len(raw), 8 + struct.unpack_from("<I", raw, 4)[0]))]
    while todo:
        at, end = todo.pop(0)
        for name, a, b in _chunks(raw, at, end):
            if name == b"LIST" and raw[a : a + 4] == b"movi":
                movi = a
                walked = [(x, y) for n, x, y in _chunks(raw, a + 4, b) if n[2:] in (b"dc", b"db")]
            elif name == b"LIST":
                todo.append((a + 4, b))
            elif name == b"strh" and raw[a : a + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", raw, a + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"ICMT":
                comment = raw[a:b].rstrip(b"\0")
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", raw, i) for i in range(a, b - 15, 16)]
    if movi is None:
        raise BadMedia("no frames")
    video = [(o, n) for name, _, o, n in index if name[2:] in (b"dc", b"db")]
    if not video:
        return fps, walked, comment
    base = movi if raw[movi + video[0][0] : movi + video[0][0] + 4][2:] in (b"dc", b"db") else 0
    return fps, [(base + o + 8, base + o + 8 + n) for o, n in video], comment


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbol by (length, code), codes being dealt in order of length."""
    table, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _header(raw: bytes) -> dict:
    """Tables and scan bytes of one baseline frame."""
    if raw[:2] != b"\xff\xd8":
        raise BadMedia("no frame start")
    out, at = {"q": {}, "h": {}, "dri": 0}, 2
    while at + 4 <= len(raw):
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                out["q"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["h"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif marker == 0xDD:
            out["dri"] = struct.unpack(">H", body)[0]
        elif 0xC1 <= marker <= 0xCF:
            raise BadMedia("not a baseline frame")
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = raw.rfind(b"\xff\xd9")
            out["data"] = raw[at + 2 + size : end if end > 0 else len(raw)]
            return out
        at += 2 + size
    raise BadMedia("no scan")


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _coded(head: dict, data: bytes) -> np.ndarray:
    """Coefficients of the first component by reading the scan bit by bit: the general case."""
    tables = {k: _huffman(*v) for k, v in head["h"].items()}
    first, blocks = head["scan"][0][0], []
    plan = [
        (c == first, tables[t >> 4], tables[16 + (t & 15)], c)
        for c, t in head["scan"]
        for _ in range(head["parts"][c][0] * head["parts"][c][1] if len(head["scan"]) > 1 else 1)
    ]
    for piece in _RESTART.split(data):
        piece = piece.replace(b"\xff\x00", b"\xff")
        bits, at, before = np.unpackbits(np.frombuffer(piece, np.uint8)).tolist(), 0, {}

        def symbol(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                code, at = 2 * code + bits[at], at + 1
                if (length, code) in table:
                    return table[length, code]
            raise BadMedia("no such code")

        def amplitude(size):
            nonlocal at
            value = 0
            for b in bits[at : at + size]:
                value = 2 * value + b
            at += size
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        units, width = 0, -(-head["width"] // 8) * -(-head["height"] // 8)
        limit = head["dri"] or width
        try:
            while units < limit:
                for wanted, dc, ac, part in plan:
                    block = [0] * 64
                    before[part] = block[0] = before.get(part, 0) + amplitude(symbol(dc))
                    k = 1
                    while k < 64:
                        s = symbol(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = amplitude(s & 15)
                        k += 1
                    if wanted:
                        blocks.append(block)
                units += 1
        except IndexError:  # the padding bits at the end of a scan
            pass
    return np.array(blocks, np.int32).reshape(-1, 64)


def decode_frames(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(coefficients, frame of each block, samples) of all frames; samples only where all
    frames use the one-symbol tables of write_avi."""
    heads, simple, cells, own = {}, [], [], []
    for a, b in ranges:
        start = raw.find(b"\xff\xda", a, b)
        key = raw[a : start + 10]
        if key not in heads:
            heads[key] = _header(raw[a:b])
            fixed = (b"\x01" + b"\0" * 15, b"\x08")
            heads[key]["fixed"] = heads[key]["h"].get(0) == fixed and heads[key]["h"].get(16) == fixed and heads[key]["dri"] == 1
        head = heads[key]
        if not head["fixed"]:
            one = _header(raw[a:b])
            coefficients = _coded(one, one["data"])
            q = one["q"][one["parts"][one["scan"][0][0]][2]].astype(np.int32)
            simple.append(coefficients * q)
            own.append(len(coefficients))
            continue
        end = raw.rfind(b"\xff\xd9", a, b)
        pieces = _RESTART.split(raw[start + 10 : end])
        own.append(len(pieces))
        cells += [p.replace(b"\xff\x00", b"\xff") for p in pieces]
    frame = np.repeat(np.arange(len(ranges)), own)
    if simple:
        if cells:
            raise BadMedia("frames of two kinds")
        return np.concatenate(simple), frame, None
    bits = np.unpackbits(np.frombuffer(b"".join(cells), np.uint8)).reshape(-1, 64, 9)
    samples = np.packbits(bits[:, :, 1:].reshape(-1, 512), axis=1)
    values = samples.astype(np.int16)
    values[values < 128] -= 255
    return values, frame, samples


def shots(coefficients: np.ndarray, frame: np.ndarray, n_frames: int) -> list[tuple[int, int]]:
    """[first, last) frames of each shot by luma histogram differences and an adaptive cut."""
    counts = np.zeros((n_frames, BINS), np.int64)
    for at in range(0, len(frame), 65536):
        pixels = coefficients[at : at + 65536].astype(np.float32) @ _PIXELS
        level = (np.clip(pixels + 128, 0, 255).astype(np.uint8) >> 4).astype(np.int64)
        key = frame[at : at + 65536, None] * BINS + level
        counts += np.bincount(key.ravel(), minlength=n_frames * BINS).reshape(n_frames, BINS)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    change = (np.abs(np.diff(share, axis=0)).sum(1) / 2).tolist()
    cuts, n, total, squares = [0], 0, 0.0, 0.0
    for i, d in enumerate(change):
        mean = total / n if n else 0.0
        spread = max(squares / n - mean * mean, 0.0) ** 0.5 if n else 0.0
        if n >= 2 and d > CUT_LEAST and d > mean + CUT_STD * spread:
            cuts.append(i + 1)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + d, squares + d * d
    return list(zip(cuts, [*cuts[1:], n_frames]))


def read_avi(raw: bytes) -> tuple[float, list[tuple[int, int]], bytes | None]:
    """(frames a second, shots as frame ranges, stored payload if the file holds one)."""
    fps, ranges, comment = read_index(raw)
    if not ranges:
        return fps, [], None
    coefficients, frame, samples = decode_frames(raw, ranges)
    found = shots(coefficients, frame, len(ranges))
    payload = None
    if samples is not None and (m := re.fullmatch(rb"payload_bytes=(\d+)", comment)):
        payload = samples.tobytes()[: int(m[1])]
    return fps, found, payload


def feature(fps: float, found: list[tuple[int, int]]) -> str:
    clips = ",".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in found)
    return f"frames={found[-1][1] if found else 0};shots={len(found)};clips={clips}"


_STORED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def store_texts(docs: DataFrame) -> DataFrame:
    """Store each whole text of docs(doc_id, text) as an AVI file, read it back, describe it.

    Null and empty texts are one block of zeros. The result depends on the text alone;
    repeated rows and null ids come back as given; other columns are not read. No shuffle.
    """

    def run(columns):
        rows = []
        for text in columns[1]:
            raw = (text or "").encode("utf-8", "replace")
            media = write_avi(pad(raw))
            fps, found, payload = read_avi(media)
            rows.append(
                (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
                 hashlib.sha256(media).hexdigest(), feature(fps, found))
            )
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [f.split()[0] for f in _STORED.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names
        )

    return by_text(docs, ["doc_id", "text"], _STORED, run)


def clip_rows(media: DataFrame) -> DataFrame:
    """(id, clip, start_s, end_s, first_frame, n_frames, error) of media(id, content).

    One row per shot. Null, empty and unreadable files give one row with clip null and the
    reason in error. Rows and ids may repeat; other columns are not read.
    """
    schema = "id long, clip int, start_s double, end_s double, first_frame long, n_frames long, error string"

    def run(columns):
        rows = []
        for i, raw in zip(*columns):
            try:
                fps, found, _ = read_avi(raw or b"")
                rows += [(i, k, a / fps, b / fps, a, b - a, None) for k, (a, b) in enumerate(found)]
            except (BadMedia, struct.error, KeyError, IndexError, ValueError) as e:
                rows.append((i, None, None, None, None, None, str(e) or type(e).__name__))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return by_text(media.select(F.col("id").cast("long"), "content"), ["id", "content"], schema, run)
