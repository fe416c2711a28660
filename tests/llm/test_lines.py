import random

import numpy as np
import pytest
import xxhash

from stratalog.llm import lines as L
from tests.llm.test_common import union_find


def row_hash(i, t):
    """As Spark's xxhash64 of a long and a string: nulls leave the seed as it is."""
    seed = 42
    if i is not None:
        seed = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed)
    if t is not None:
        seed = xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows):
    """Removed lines, by (id is null, id, row hash), from comparing every two lines."""
    lines = [((i is None, i, row_hash(i, t)), no, s) for i, t in rows for no, s in enumerate(L.normal_lines(t or "")) if s]
    texts = sorted({s for _, _, s in lines})
    sets = {s: L.shingles(s) for s in texts}
    edges = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if len(sets[a] & sets[b]) >= L.SIMILARITY * len(sets[a] | sets[b])]
    root = union_find(edges)
    first = {}
    for i, no, s in lines:
        r = root.get(s, s)
        first[r] = min((i, no), first.get(r, (i, no)))
    gone = {}
    for i, no, s in lines:
        if (i, no) != first[root.get(s, s)]:
            gone.setdefault(i, set()).add(no)
    return {i: sorted(g) for i, g in gone.items()}


def test_report(make, odd_rows, corpus):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(100 + i, t) for i, t in corpus]
    got = L.dedup_report(make(rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and sum(map(len, want.values())) > 40
    found = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.removed) for r in got)
    gone = [(i, t, want.get((i is None, i, row_hash(i, t)), [])) for i, t in rows]
    assert found == sorted((str(i), 0 if t is None else t.count("\n") + 1, len(g), ",".join(map(str, g))) for i, t, g in gone)
    assert {r.n_lines for r in got if r.doc_id == 2} == {0} and {r.n_lines for r in got if r.doc_id == 3} == {1}
    assert L.dedup_report(make([])).count() == 0


def test_cleaned_documents(make, corpus, odd_rows):
    rows = [(100 + i, t) for i, t in corpus] + [r for r in odd_rows if len(r[1] or "") < 10_000]
    gone = brute(rows)
    want = []
    for i, t in rows:
        g = gone.get((i is None, i, row_hash(i, t)))
        left = t if not g else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in g)
        if not g or left.strip():
            want.append((i, left))
    got = L.without_repeats(make(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str) and all(r.removed == "x" for r in got)


def test_no_unique_line_is_lost(make):
    """Repeated ids with equal, unlike and null texts: every line that goes stays somewhere."""
    shared = "a line that stands in more than one row of the table"
    rows = [(3, shared), (5, f"{shared}\nonly in row A, at its second place"), (5, f"only in row B, at its first place\n{shared}"),
            (5, f"only in row B, at its first place\n{shared}"), (5, None), (None, shared), (None, f"{shared}\nno id, but own text"), (None, None),
            (7, "Of.\n\n}\n\nown"), (8, "of.\n}\nmine")]
    got = L.without_repeats(make(rows)).collect()
    lines = lambda texts: {s for t in texts for s in L.normal_lines(t or "")}
    assert lines(r.text for r in got) == lines(t for _, t in rows)
    texts = sorted(str(r.text) for r in got)
    assert texts == sorted([
        shared, "only in row A, at its second place", "only in row B, at its first place", "only in row B, at its first place",
        "None", "no id, but own text", "None", "Of.\n\n}\n\nown", "mine",
    ])


def test_recall_of_bands():
    rng = random.Random(8)
    missed = tried = 0
    for _ in range(1500):
        line = "".join(rng.choice("abcdefghijklmnopqrstu  ") for _ in range(rng.randint(60, 400)))
        other = list(line)
        for k in rng.sample(range(len(other)), max(1, len(other) // 90)):
            other[k] = "z"
        other = "".join(other)
        a, b = L.shingles(line), L.shingles(other)
        if len(a & b) / len(a | b) >= L.SIMILARITY:
            tried += 1
            x, y = L.band_keys([line, other])
            missed += not (x == y).any()
    assert tried > 800 and missed / tried < 0.005


@pytest.mark.parametrize("block", [3, 5, 2000])
def test_units_hold_every_pair(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        n = rng.randint(0, 60)
        keys = np.array([rng.randrange(5) for _ in range(n)], np.uint64)
        members = np.array([rng.randrange(25) for _ in range(n)], np.uint64)
        _, unit, line = L.group_members(keys, members)
        groups = {}
        for u, m in zip(unit.tolist(), line.tolist()):
            groups.setdefault(u, set()).add(m)
        pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b}
        want = {(int(a), int(b)) for k in range(5) for a in members[keys == k] for b in members[keys == k] if a < b}
        assert pairs == want and all(len(g) <= 2 * block for g in groups.values())


@pytest.mark.parametrize("cells", [0, 8_000_000])
def test_unit_links(monkeypatch, cells):
    monkeypatch.setattr(L, "MATRIX_CELLS", cells)
    rng = random.Random(2)
    for n in (2, 9, 40):
        base = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(4)]
        texts = []
        for _ in range(n):
            t = list(rng.choice(base))
            for k in rng.sample(range(150), rng.randint(0, 3)):
                t[k] = "z"
            texts.append("".join(t))
        texts = list(dict.fromkeys(texts))
        sets = [L.shingles(t) for t in texts]
        links = L.unit_links(texts)
        want = union_find([(i, j) for i in range(len(texts)) for j in range(i) if L.similar(sets[i], sets[j])])
        assert union_find(links) == want and len(links) < len(texts)


def test_hot_keys(make, monkeypatch):
    """Near copies and templated lines on one key: all are found, no unit is beyond two blocks,
    and near copies leave nothing to pair."""
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "HOT_IN_BATCH", 20)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    same, template = word(200), word(60)
    near = [same[:k] + "z" + same[k + 1 :] for k in range(150)]
    loose = [template + word(rng.choice([8, 20, 30, 45])) for _ in range(150)]
    rows = list(enumerate(near + loose + [s[:-2] + "zz" for s in loose[:40]]))
    got = {r.doc_id: r.removed for r in L.dedup_report(make(rows)).collect() if r.removed}
    want = {i: ",".join(map(str, g)) for (_, i, _), g in brute(rows).items()}
    assert got == want and len(want) > 170
    spark = make(rows).sparkSession
    for texts, pairs in ((near, False), (loose, True)):
        ids = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
        links, units, _ = L.hot_links(ids.selectExpr("7L AS key", "line"), ids)
        edges = {(r.u, r.v) for r in links.collect()}
        held = {}
        for r in units.collect():
            held.setdefault(r.unit, []).append(r.line)
        assert (len(held) > 0) == pairs and max(map(len, held.values()), default=0) <= 40
        found = union_find([*edges, *((g[a], g[b]) for g in held.values() for a, b in L.unit_links([texts[i] for i in g]))])
        sets = [L.shingles(t) for t in texts]
        assert found == union_find([(i, j) for i in range(150) for j in range(i) if L.similar(sets[i], sets[j])])


def test_a_hot_key_leaves_as_it_is(spark):
    """30,000 lines on one key are 30,000 rows, not one for each two blocks and line."""
    keys, members = np.full(30_000, 5, np.uint64), np.arange(30_000, dtype=np.uint64)
    cold = np.array([9, 9], np.uint64), np.array([1, 2], np.uint64)
    packed = [(0, bytearray(k.tobytes()), bytearray(m.tobytes())) for k, m in ((keys, members), cold)]
    got = L.candidate_units(spark.createDataFrame(packed, "bucket int, keys binary, members binary"))
    assert got.where("home IS NULL AND unit = 5").count() == 30_000 and got.where("home IS NOT NULL").count() == 2


def test_telling_shingles():
    """Of two similar sets one of the smaller's first tokens is among the larger's."""
    rng = random.Random(5)
    pool = np.array(sorted(rng.getrandbits(64) for _ in range(90)), np.uint64)
    common = pool[::2]
    times = np.array([rng.randint(1, 8) for _ in common])
    tried = 0
    for _ in range(4000):
        a = set(rng.sample(range(90), rng.randint(1, 60)))
        b = (a | set(rng.sample(range(90), rng.randint(0, 6)))) - set(rng.sample(range(90), rng.randint(0, 8)))
        if b and L.similar(a, b):
            tried += 1
            small, large = sorted((a, b), key=len)
            (x, enough), (y, _) = (L.telling(pool[sorted(s)], common, times) for s in (small, large))
            assert set(x[:enough].tolist()) & set(y.tolist()) and enough <= len(x) <= len(small)
    assert tried > 1500


def test_templated_lines_meet_by_shingles(spark, monkeypatch):
    """Lines on one key, most of them unlike though they share four fifths, among them groups of near
    copies, one large: every similar pair is connected, in fewer rows than blocks take."""
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    template = word(70)
    texts = [template + word(rng.choice([8, 10, 14])) for _ in range(500)]
    for size in (3, 3, 12, 90):
        tail = template[:50] + word(40)
        texts += [tail[:-3] + word(3) for _ in range(size)]
    texts = list(dict.fromkeys(texts))
    ids = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
    hot = ids.selectExpr("7L AS key", "line")
    links, units, _ = L.hot_links(hot, ids)
    held = {}
    for r in units.collect():
        held.setdefault(r.unit, []).append(r.line)
    found = union_find([*((r.u, r.v) for r in links.collect()), *((g[a], g[b]) for g in held.values() for a, b in L.unit_links([texts[i] for i in g]))])
    sets = [L.shingles(t) for t in texts]
    want = union_find([(i, j) for i in range(len(texts)) for j in range(i) if L.similar(sets[i], sets[j])])
    assert found == want and len(want) > 90
    monkeypatch.setattr(L, "LEVELS", 1)
    by_blocks = L.hot_links(hot, ids)[1].count()
    assert sum(map(len, held.values())) < by_blocks


def templated(n, seed=3):
    """Lines of one template: 66 equal characters and six random words; few are near copies."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    head = "the quick brown template of sixty-six equal characters stands here"
    return [f"{head} {' '.join(rng.choices(vocab, k=6))}" for _ in range(n)]


def test_templated_lines_against_brute_force():
    texts = templated(3000)
    texts += [t + "q" for t in texts[::100]]
    sets = [L.shingles(t) for t in texts]
    want = L._reach(len(texts), lambda one, left: np.array([L.similar(sets[one], sets[k]) for k in left.tolist()], bool))
    assert union_find(L.unit_links(texts)) == union_find(want) and len(want) >= 30


def test_lines_named_alike_by_accident(spark):
    lines = [(1, 1, 0, 7, 70), (2, 2, 0, 7, 70), (3, 3, 0, 7, 71), (4, 4, 1, 7, 71), (5, 5, 0, 8, 80), (6, 6, 0, 8, 80), (9, 9, 0, 7, 72)]
    lines = spark.createDataFrame(lines, "id long, row long, line_no int, line long, mark long")
    place = lambda i: (i, i, 0)
    keep = spark.createDataFrame([(7, 70, True, place(1)), (8, 80, False, place(5))], "line long, own long, mixed boolean, keep struct<id:long,row:long,line_no:int>")
    assert sorted(r.id for r in L.going(lines, keep).collect()) == [2, 4, 6]


def test_a_large_component_is_not_gone_through_for_the_few_beside_it():
    """400 members, 370 of them alike, 10 near one of these, 20 alone; the same where groups are known."""
    asked = []

    def near(one, others):
        asked.append(one)
        alike = (others < 370) if one < 370 else np.zeros(len(others), bool)
        return alike | ((one < 380) & (others < 380) & (np.abs(others - one) == 370)) | (others == one)

    want = {frozenset(range(380))} | {frozenset([k]) for k in range(380, 400)}

    def parts(links):
        root = union_find([*links, *((k, k) for k in range(400))])
        found = {}
        for k in range(400):
            found.setdefault(root.get(k, k), set()).add(k)
        return set(map(frozenset, found.values()))

    assert parts(L._reach(400, near)) == want and len(asked) < 100
    asked.clear()
    group = np.where(np.arange(400) < 370, 0, np.arange(400))
    links = L._reach(400, near, group)
    assert len(links) == 10 and parts([*links, *((0, k) for k in range(370))]) == want and len(asked) < 100


def test_lines_that_pivots_connect_are_not_compared_again(make, monkeypatch):
    """Edited copies of one line on one hot key: they are similar to different pivots, and what these connect
    is compared with the few others only, of which all similar ones are found."""
    monkeypatch.setattr(L, "BLOCK", 40)
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(60)]
    texts = []
    for _ in range(400):
        words = list(base)
        for k in rng.sample(range(60), rng.randint(1, 6)):
            words[k] = "".join(rng.choices("qrstuvwxyz", k=5))
        texts.append(" ".join(words))
    spark = make([(0, "a")]).sparkSession
    ids = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
    links, units, _ = L.hot_links(ids.selectExpr("7L AS key", "line"), ids)
    held = {}
    for r in units.collect():
        held.setdefault(r.unit, {})[r.line] = r.root
    compared = sum(len(g) for g in held.values())
    edges = [(r.u, r.v) for r in links.collect()]
    for g in held.values():
        g = list(g.items())
        group = np.array([k if r is None else 1000 + r for k, r in g])
        edges += [(g[a][0], g[b][0]) for a, b in L.unit_links([texts[k] for k, _ in g], None, group)]
    sets = [L.shingles(t) for t in texts]
    assert union_find(edges) == union_find([(i, j) for i in range(400) for j in range(i) if L.similar(sets[i], sets[j])])
    assert compared < 5000, compared
