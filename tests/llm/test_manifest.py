import hashlib
import random
import zlib

import pytest

from stratalog.llm import manifest as M

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, level int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """Lists of all levels, one row at a time."""

    def leaf(r, more=0):
        i, text, lang, source, n = r[:5]
        part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        return sha("".join(map(part, (i, source, lang, None if n is None else n + more, text))))

    def tree(nodes):
        """The top, and the steps of each node: (side, digest) or None."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(at):
                s = i ^ 1
                steps[k].append((s & 1, level[s]) if s < len(level) else None)
            level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
            at = [i // 2 for i in at]
        return level[0], steps

    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (first(r[0]), leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in order[x]]) for x in langs}
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, upper):
        for r, steps in zip(order[x], trees[x][1]):
            path = steps + up
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur = leaf(r, int(changed))
            for s in path:
                cur = sha(cur if s is None else cur + s[1] if s[0] else s[1] + cur)
            proof = sha("".join(s[1] for s in path if s))
            out.append((r[0], leaf(r), trees[x][0], root, proof, cur, cur == root))
    return out


def of(rows):
    rng = random.Random(rows)
    langs = ["en"] * 5 + ["de", "é", "", None, "zz"]
    return [(i, rng.choice(["a b", "", None, "é" * i]), rng.choice(langs), rng.choice(["web", None]), rng.choice([None, i, 0]), "x", "y", 1) for i in range(rows)]


@pytest.mark.parametrize("n, step", [(1, 8), (3, 1), (37, 2), (700, 8)])
def test_against_lists(spark, n, step):
    check(spark, of(n), step)


def test_odd_rows(spark):
    rows = of(40)
    rows += rows[:9] * 3 + [(None, "t", "en", "web", 5, "x", "y", 1)] * 2 + [(7, "other", "en", None, 1, "x", "y", 1), (14, "w " * 90_000, "en", None, (1 << 63) - 1, "x", "y", 1)]
    rows += [(10_000 + i, "only one of its language", f"l{i}", None, i, "x", "y", 1) for i in range(9)]
    check(spark, rows)
    assert M.verified_manifest(spark.createDataFrame([], COLUMNS)).count() == 0
    assert M.manifest(spark.createDataFrame([], COLUMNS)).root is None


def check(spark, rows, step=M.STEP):
    got = M.verified_manifest(spark.createDataFrame(rows, COLUMNS).repartition(3), step).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
