import random
import re

import numpy as np
import pytest
import xxhash

from stratalog.llm import common as C
from stratalog.llm import simhash as S
from tests.llm.test_common import union_find
from tests.llm.test_lines import row_hash


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [by_definition(t) for _, t in rows]
    distinct = sorted(set(fps))
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if bin(a ^ b).count("1") <= 3]
    root = union_find(edges)
    least = {}
    for (i, _), f in zip(rows, fps):
        r = root.get(f, f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{f:016x}", least.get(root.get(f, f))) for (i, _), f in zip(rows, fps)), key=str)


def test_fingerprints(odd_rows):
    for _, t in odd_rows + [(0, "a"), (0, "A b"), (0, "a\x1cb c d")]:
        if len(t or "") < 10_000:
            assert S.fingerprint(t) == by_definition(t)


def test_nearest_codewords_are_near():
    nearest = S._nearest_codeword()
    words = {}
    for x in range(1 << 12):  # each index's codeword: the word with those top bits and no remainder
        w = x << 11
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= S._GENERATOR << (bit - 11)
        words[x] = (x << 11) | w
    assert all(bin(words[int(nearest[v])] ^ v).count("1") <= 3 for v in range(0, 1 << 16, 7))


def test_keys_meet_within_three_bits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        fps = np.array([rng.getrandbits(64) for _ in range(1500)], np.uint64)
        flip = np.array([sum(1 << b for b in rng.sample(range(64), n)) for _ in fps], np.uint64)
        mine, other = (set(zip(*(x.tolist() for x in S.fuzzy_keys(f)))) for f in (fps, fps ^ flip))
        assert {r for r, _ in mine & other} == set(range(len(fps)))


@pytest.mark.parametrize("seed", range(3))
def test_links_of_dense_fingerprints(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)} | {0, 7, (1 << 64) - 1}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    labels = S.component_labels(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    root = union_find([(a, b) for a in fps for b in fps if a > b and bin(a ^ b).count("1") <= 3])
    order = {f: i for i, f in enumerate(sorted(fps))}
    least = {}
    for f in fps:
        least[root.get(f, f)] = min(order[f], least.get(root.get(f, f), 1 << 60))
    assert {r.fp % (1 << 64): r.component_id for r in labels} == {f: least[root.get(f, f)] for f in fps}


def test_rows(make, odd_rows, corpus):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(100 + i, t) for i, t in corpus]
    assert sorted(map(tuple, S.near_duplicates(make(rows)).collect()), key=str) == brute(rows)
    assert S.near_duplicates(make([])).count() == 0


def test_one_of_each_stays(make, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(None, "same"), (None, "all alone and without id"), (None, "all alone and without id")]
    kept = S.keep_one(make(rows)).collect()
    fps = {t: by_definition(t) for _, t in rows}
    root = union_find([(a, b) for a in fps.values() for b in fps.values() if a > b and bin(a ^ b).count("1") <= 3])
    groups = {}
    for i, t in rows:
        groups.setdefault(root.get(fps[t], fps[t]), []).append((i is None, i or 0, row_hash(i, t), t))
    assert sorted((r.doc_id is None, r.doc_id or 0, row_hash(r.doc_id, r.text), r.text) for r in kept) == sorted(min(g) for g in groups.values())
    assert all(r.nth == "x" for r in kept) and {(r.doc_id, r.text) for r in kept} >= {(5, "same"), (5, "other text under one id")}


def test_large_buckets(monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    for place in range(4):
        low = [48 - 16 * ((place + k) % 4) for k in (2, 3)]
        members = {base ^ (rng.getrandbits(16) << low[0]) ^ (rng.getrandbits(16) << low[1]) for _ in range(300)}
        members |= {m ^ (1 << low[0] + rng.randrange(16)) for m in list(members)[:100]}
        members = np.array(sorted(members), np.uint64)
        monkeypatch.setattr(S, "LARGE_BUCKET", 10)
        parts = union_find([(int(a), int(b)) for a, b in S.bucket_links(place << 28, members)])
        assert parts == union_find([(int(a), int(b)) for a, b in S.spanning_links(members)]) and parts


def test_short_tables_are_few_files(spark, make, corpus, monkeypatch, tmp_path):
    """However many partitions a shuffle has."""
    kept = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in kept}
    monkeypatch.setattr(C, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(C, "discard", lambda *tables: None)
    monkeypatch.setattr(S, "discard", lambda *tables: None)
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        rows = [(i, t) for i, t in corpus] * 2
        docs = make(rows).coalesce(2)
        out = S.near_duplicates(docs)
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows)
        most = max(2, spark.sparkContext.defaultParallelism)
        files = {d.name: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
        assert {n.split("-")[0] for n in files} == {"prints", "fingerprints", "edges", "linked", "roots", "labels"}
        assert max(files.values()) <= most and out.rdd.getNumPartitions() <= most, files
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parts_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 10)
    table = spark.range(0, 1000, 1, 100)
    least = spark.sparkContext.defaultParallelism
    assert C.in_few_parts(table, 0).rdd.getNumPartitions() == least
    assert C.in_few_parts(table, 10 * least + 1).rdd.getNumPartitions() == least + 1
    assert C.in_few_parts(table, 10**6).rdd.getNumPartitions() == 100
    assert C.in_few_parts(table, 10**6).count() == C.in_few_parts(table, 0).count() == 1000
