import base64
import gzip
import hashlib
import os

import pytest

from stratalog.llm import warc as A

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9 \r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/5", "é" * 200_000), (6, "http://a/6", "\r\n\r\n"), (7, "u", "tie"), (7, "u", "tie"), (7, "v", "not tie"), (None, "n", "<p>one</p>"), (None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, refers_to string")


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and i < last[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    got = A.archive_pages(frame(spark, PAGES), folder).collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)


def test_files_roll_and_repeat(spark, tmp_path):
    rows = [(i, f"http://a/{i}", os.urandom(600).hex()) for i in range(200)]
    made = []
    for k in "ab":
        manifest = A.write_archive(frame(spark, rows), f"file://{tmp_path}/{k}", roll_bytes=20_000).orderBy("file").collect()
        made.append([tuple(r) for r in manifest])
        files = {f for f in os.listdir(tmp_path / k) if f.endswith(".gz")}
        assert files == {r.file for r in manifest} and not [f for f in os.listdir(tmp_path / k) if f.endswith(".tmp")]
        for r in manifest:
            raw = (tmp_path / k / r.file).read_bytes()
            assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r.n_bytes, r.sha256) and r.n_bytes < 22_000
            assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == r.n_records
        ids = [(r.first_page_id, r.last_page_id) for r in manifest]
        assert ids == sorted(ids) and sum(r.n_records for r in manifest) == 200
    assert made[0] == made[1]
    (tmp_path / "a" / "part-999999-00000.warc.gz").write_bytes(b"junk of a lost task")
    assert A.read_archive(spark, f"file://{tmp_path}/a").count() == 200


def test_small_payloads_can_stay_responses(spark, tmp_path):
    A.write_archive(frame(spark, PAGES), f"file://{tmp_path}/w", min_revisit_bytes=11)
    assert A.read_archive(spark, f"file://{tmp_path}/w").where("record_type = 'revisit'").count() == 0


def test_broken_records_are_found():
    raw = gzip.decompress(A.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None))
    assert A.parse_record(raw)[0] == 1
    with pytest.raises(A.BadRecord):
        A.parse_record(raw.replace(b"payload\r", b"pAyload\r"))


def test_empty_table(spark, tmp_path):
    assert A.archive_pages(frame(spark, []), f"file://{tmp_path}/w").count() == 0
