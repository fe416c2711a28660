import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from stratalog.llm import packing as P
from stratalog.llm.tokens import vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())


def check(rows, got):
    """Every id once, sequences gapless and full or a power of two."""
    tokens = [np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    total = sum(map(len, tokens))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == P.SEQUENCE or at < P.SEQUENCE and at & (at - 1) == 0
    assert sum(r.length for r in got) == total
    left = defaultdict(int)
    for (i, _), ids in zip(rows, tokens):
        left[i, len(ids)] += 1
    for r in got:
        candidates = [t for (i, _), t in zip(rows, tokens) if i == r.doc_id and len(t) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(t[r.start : r.start + r.length].tobytes()) for t in candidates}
        left[r.doc_id, r.doc_tokens] -= r.start + r.length == r.doc_tokens
    assert not any(left.values())


def test_pieces(make, odd_rows, corpus):
    rows = odd_rows + [(100 + i, t) for i, t in corpus]
    check(rows, P.pack(make(rows)).collect())
    check(rows, P.pack(make(rows).coalesce(1), shard_tokens=3000).collect())
    assert P.pack(make([])).count() == 0


def test_neighbours_share_terms():
    docs = [np.array(d, np.uint32) for d in ([1, 2, 3, 50], [4, 5, 6, 51], [1, 2, 3, 52], [7, 8, 1, 53], [9, 9, 54])]
    index = P.InvertedIndex(docs)
    unused = np.ones(5, bool)
    unused[0] = False
    assert index.neighbours(index.query[0], unused) == [2, 3]
    unused[2] = False
    assert index.neighbours(index.query[0], unused) == [3]
    assert index.neighbours(index.query[4], unused) == []


def test_like_documents_share_a_sequence(make):
    a, b = "volcano lava magma crater eruption ash", "violin sonata cello quartet fugue opus"
    rows = [(i, ((a if i % 2 else b) + " ") * 150) for i in range(16)]
    got = P.pack(make(rows).repartition(4)).collect()
    kinds = defaultdict(set)
    for r in got:
        if r.length > 700:
            kinds[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(k) == 1 for k in kinds.values()) >= len(kinds) - 1


def test_short_neighbours_are_used_up():
    """More than NEIGHBOURS short documents of a kind stay together."""
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(10, 40, 30) + 1000 * (i % 2), 2).astype(np.uint32) for i in range(160)]
    packer = P.Packer(0)
    # the end id, which all share, tells next to nothing
    packer.shard(list(range(160)), [d[:-1] for d in docs])
    packer.finish()
    kinds = [r[0] % 2 for r in packer.rows]
    assert kinds[:80] == [0] * 80 and kinds[80:160] == [1] * 80


def test_routes(make, odd_rows):
    """Documents with equal long words lie side by side, whatever partition they were in."""
    rng = np.random.default_rng(1)
    kinds = ["volcano magma", "violins sonatas", "harbour sailors", "glacier moraine"]
    rows = [(i, f"{kinds[i % 4]} of {rng.integers(99)}") for i in range(80)] + odd_rows
    got = [r.doc_id for r in P.routed(make(rows).repartition(7)).collect()]
    places = [[k for k, i in enumerate(got) if i is not None and i < 80 and i % 4 == kind and i > 8] for kind in range(4)]
    assert len(got) == len(rows) and all(p[-1] - p[0] <= len(p) + 3 for p in places)


def test_few_tasks_give_the_pieces(spark, make, odd_rows, corpus, monkeypatch):
    """However many ranges the documents are packed in, few tasks give (and write) all their
    pieces, more of them as ranges become more; what was packed in parallel stays as it was."""
    rows = odd_rows + [(100 + i, t) for i, t in corpus]
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = P.pack(make(rows))
        assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 64
        pieces = got.collect()
        check(rows, pieces)
        assert len({r.sequence_id >> 40 for r in pieces}) > 32
        monkeypatch.setattr(P, "RANGES_A_PART", 4)
        assert P.pack(make(rows)).rdd.getNumPartitions() == 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
