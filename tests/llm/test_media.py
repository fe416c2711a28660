import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = M.pad(raw)
    assert len(payload) % 64 == 0 and payload and payload[: len(raw)] == raw
    assert M.read_avi(M.write_avi(payload))[2] == payload


def test_table_driven_decoding_agrees():
    random.seed(2)
    avi = M.write_avi(M.pad(bytes(random.randrange(256) for _ in range(5000))))
    _, ranges, comment = M.read_index(avi)
    fast, frame, _ = M.decode_frames(avi, ranges)
    slow = np.concatenate([M._coded(h := M._header(avi[a:b]), h["data"]) for a, b in ranges])
    assert (fast == slow).all() and comment == b"payload_bytes=5056" and len(ranges) == frame.max() + 1
    assert all(avi[a : a + 2] == b"\xff\xd8" and avi[b - 2 : b] == b"\xff\xd9" for a, b in ranges)


def gray_frame(level, size=16):
    """A frame of one gray level in ordinary baseline coding: DC categories and ends of block."""
    dc = 8 * (level - 128)
    counts = bytes([0, 0, 0, 12, *[0] * 12])
    header = (
        b"\xff\xd8" + M._segment(0xDB, b"\x00" + b"\x01" * 64) + M._segment(0xC0, struct.pack(">BHHB", 8, size, size, 1) + b"\x01\x11\x00")
        + M._segment(0xC4, b"\x00" + counts + bytes(range(12))) + M._segment(0xC4, b"\x10\x01" + b"\0" * 15 + b"\x00")
        + M._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )
    bits, before = "", 0
    for _ in range((size // 8) ** 2):
        diff, before = dc - before, dc
        n = abs(diff).bit_length()
        bits += f"{n:04b}" + (f"{diff if diff > 0 else diff + (1 << n) - 1:0{n}b}" if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    return header + data + b"\xff\xd9"


def avi_of(frames, index=True):
    movi, entries, at = b"", b"", 4
    for f in frames:
        entries += struct.pack("<4sIII", b"00dc", 16, at, len(f))
        movi += M._chunk(b"00dc", f)
        at = 4 + len(movi)
    strh = struct.pack("<4s4sIHHIIII", b"vids", b"MJPG", 0, 0, 0, 0, 1, 10, 0)
    head = M._list(b"hdrl", M._list(b"strl", M._chunk(b"strh", strh)))
    return M._chunk(b"RIFF", b"AVI " + head + M._list(b"movi", movi) + (M._chunk(b"idx1", entries) if index else b""))


@pytest.mark.parametrize("index", [True, False])
def test_shots_of_an_ordinary_file(spark, index):
    raw = avi_of([gray_frame(40)] * 6 + [gray_frame(200)] * 5 + [gray_frame(90)] * 4, index)
    rows = [(1, raw), (2, None), (3, b""), (4, raw[:60]), (5, b"RIFF0000AVI "), (1, raw)]
    got = M.clip_rows(spark.createDataFrame(rows, "id long, content binary")).orderBy("id", "clip").collect()
    assert [(r.clip, r.start_s, r.end_s, r.n_frames) for r in got if r.id == 1][::2] == [(0, 0.0, 0.6, 6), (1, 0.6, 1.1, 5), (2, 1.1, 1.5, 4)]
    assert all(r.clip is None and r.error for r in got if r.id != 1) and {r.id for r in got} == {1, 2, 3, 4, 5}


def test_rows(make, odd_rows):
    got = M.store_texts(make(odd_rows)).collect()
    by_text = {}
    for r in got:
        by_text.setdefault((r.n_bytes, r.payload_sha256), set()).add(tuple(r)[1:])
    assert len(got) == len(odd_rows) and all(len(v) == 1 for v in by_text.values())
    for i, t in odd_rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert any(tuple(r)[:5] == want for r in got), i
    assert M.store_texts(make([])).count() == 0
