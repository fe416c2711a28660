"""Merkle manifest of a table: one digest per row, a tree over the rows of each language, a
tree over the languages, and for each row the proof that leads to the root.

Nodes are known by coordinates (tree, level, number) and lie in Parquet by level. Rows are
sorted once, by ranges, and numbered from the counts of the ranges. The nodes of a level
stream in that order, a block of 2^STEP nodes after another, into the STEP levels above them,
of which the last is what the next step reads; a task holds one block. Proofs are found from
the top down by a scan that merges the levels in the order of coordinates and holds one pair
of nodes of each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import discard, fresh_dir, map_batches, stored

#: Levels that one reading of the store adds to it.
STEP = 8

#: Columns whose values make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "key string, n long, idx long, digest string, level int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list) -> F.Column:
    """SHA-256 of the fields, each `-` if null, else its bytes' count, `:` and its value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def tampered(doc_id) -> F.Column:
    """Whether the row of this id is the one that the check of proofs changes."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, spread, digest, other) of docs: key is the tree, "" for null and else the
    language after a "+"; spread tells equal rows apart; other is the digest of the changed row,
    null where the row does not change."""
    fields = [F.col(c) for c in FIELDS]
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = [one_more if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("spread"),
        leaf_digest(fields).alias("digest"),
        F.when(tampered(F.col("doc_id")), leaf_digest(changed)).alias("other"),
    )


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(key, ...) with idx, their number from 0 in the given order among those of their key,
    and n, how many these are; and the table to discard after they were read.

    Ranges are sorted side by side; only a row for each range and key in it is summed up.
    """
    ordered = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(ordered.select("*", F.spark_partition_id().alias("part"), nth.alias("nth")), "sorted")
    runs = placed.groupBy("key", "part").agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = runs.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    return placed.join(at, ["key", "part"]).withColumn("idx", F.col("nth") + F.col("shift")).drop("part", "nth", "shift"), placed


def _grow(key: str, n: int, first: int, digests: list[str], step: int):
    """(key, n, idx, digest, levels up) of the nodes over a block of digests from number first on, in a
    level of n nodes, up to its top or step levels."""
    for up in range(1, step + 1):
        if n == 1:
            return
        digests = [sha("".join(digests[k : k + 2])) for k in range(0, len(digests), 2)]
        n, first = (n + 1) // 2, first // 2
        for k, digest in enumerate(digests):
            yield key, n, first + k, digest, up


def add_levels(below: DataFrame, level: int, path: str, step: int) -> None:
    """Append to the store at path the step levels over below(key, n, idx, digest)."""

    def run(batches):
        at, held, first, n = None, [], 0, 0
        names, kinds = ["key", "n", "idx", "digest", "level"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]

        def made(rows):
            columns = list(zip(*rows))
            columns[4] = [level + up for up in columns[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        rows = []
        for batch in batches:
            for key, of, idx, digest in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (key, idx >> step) != at:
                    if held:
                        rows += _grow(at[0], n, first, held, step)
                    at, held, first, n = (key, idx >> step), [], idx, of
                    if len(rows) > 10_000:
                        yield made(rows)
                        rows = []
                held.append(digest)
        if held:
            rows += _grow(at[0], n, first, held, step)
        if rows:
            yield made(rows)

    blocks = below.where("n > 1").select("key", "n", "idx", "digest").repartition("key", F.shiftright("idx", step))
    grown = map_batches(blocks.sortWithinPartitions("key", "idx"), run, _NODES)
    grown.write.partitionBy("level").mode("append").parquet(path)


@dataclass
class Tree:
    """Trees of several keys: their leaves(key, n, idx, digest, ...), the store of the nodes above
    them, None where no tree has more than a leaf, the leaves of the largest, and the levels of a
    block."""

    leaves: DataFrame
    nodes: DataFrame | None
    most: int
    step: int

    def tops(self) -> DataFrame:
        """(key, leaves, digest): the top node of each tree."""
        alone = self.leaves.where("n = 1").select("key", "digest")
        found = alone if self.nodes is None else alone.unionByName(self.nodes.where("n = 1").select("key", "digest"))
        return found.join(self.leaves.where("idx = 0").select("key", F.col("n").alias("leaves")), "key")

    def level(self, level: int) -> DataFrame:
        return self.leaves if level == 0 else self.nodes.where(F.col("level") == level)


def grow(leaves: DataFrame, step: int = STEP) -> Tree:
    """All levels over leaves(key, n, idx, digest)."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 0
    path, level, n, nodes = fresh_dir(spark, "nodes"), 0, most, None
    while n > 1:
        add_levels(leaves if level == 0 else nodes.where(F.col("level") == level), level, path, step)
        nodes = spark.read.schema(_NODES).parquet(path)
        level, n = level + step, -(-n >> step)
    return Tree(leaves, nodes, most, step)


def _pairs(rows: DataFrame, base: int, step: int) -> DataFrame:
    """Nodes of one level or several, base the lowest, with the places by which the scan meets them."""
    up = F.col("level") - base
    start = F.expr(f"shiftleft(shiftright(idx, 1), level - {base} + 1)")
    return rows.select("*", F.expr(f"shiftright(idx, {step} - (level - {base}))").alias("block"), start.alias("start"), up.alias("up"))


def scan_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves with subroot, their tree's top, and path: the steps from a leaf to its top, and
    on by those of above(key, leaves, digest, path), comma-joined. A step is L or R and the digest
    of the node that joins on that side, or a dot where a node is alone in its run.

    A block meets the steps above it, then, by place and from the top level down, the nodes of
    its levels; each node is held until the next of its level is met.
    """
    extra = [c for c in tree.leaves.columns if c not in ("key", "n", "idx", "digest")]
    kinds = dict(tree.leaves.dtypes)
    step, starts = tree.step, [0]
    while -(-tree.most >> (starts[-1] + step)) > 1:
        starts.append(starts[-1] + step)
    over = lambda level: F.expr(f"-shiftright(-leaves, {level})")  # noqa: E731  nodes of a level
    found = None
    for base in reversed(starts):
        more = extra if base == 0 else []
        ends = above.where((over(base + step) == 1) & ((over(base) > 1) | F.lit(base == 0)))
        ends = ends.select("key", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "path")
        tops = ends if found is None else ends.unionByName(found.select("key", F.col("idx").alias("block"), "subroot", "path"))
        parts = [
            tops.select("*", F.expr(f"shiftleft(block, {step})").alias("start"), F.lit(step).alias("up")),
            _pairs(tree.level(base).where(F.lit(base == 0) | (F.col("n") > 1)).select("key", "n", "idx", "digest", *more, F.lit(base).alias("level")), base, step),
        ]
        if tree.nodes is not None:
            between = tree.nodes.where(F.col("level").between(base + 1, base + step - 1) & (F.col("n") > 1))
            parts.append(_pairs(between, base, step))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        names = ["key", "block", "up", "n", "idx", "digest", "subroot", "path", *more]
        rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "start", F.desc("up"), "idx").select(*names)
        schema = ", ".join(["key string, n long, idx long, digest string, subroot string, path string", *(f"{c} {kinds[c]}" for c in more)])
        found = map_batches(rows, _merge(step, [f.split()[0] for f in schema.split(", ")]), schema)
    return found


def _merge(step: int, names: list[str]):
    def run(batches):
        block, pairs, top, out, waiting, types = None, [None] * step, ("", ""), [], [], None

        def settle():
            """Steps of the one or two lowest nodes that were waiting for each other."""
            for n, idx, digest, more in waiting:
                path, of = [], n
                for up in range(step):
                    if of == 1:
                        break
                    at = (idx >> up) ^ 1
                    path.append("." if at >= of else ("R" if at & 1 else "L") + pairs[up][at])
                    of = (of + 1) // 2
                if top[1]:
                    path.append(top[1])
                out.append((block[0], n, idx, digest, top[0], ",".join(path), *more))
            waiting.clear()

        def made():
            columns = zip(*out)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            out.clear()
            return made

        for batch in batches:
            kinds = [f.type for f in batch.schema]
            types = [kinds[0], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], *kinds[8:]]
            for key, of, up, n, idx, digest, subroot, path, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, of) != block or up == step:
                    settle()
                    block = key, of
                if up == step:
                    top = subroot, path
                    continue
                if up == 0 and waiting and waiting[0][1] >> 1 != idx >> 1:
                    settle()
                elif up:
                    settle()
                if pairs[up] is None or (idx ^ 1) not in pairs[up] or len(pairs[up]) > 1:
                    pairs[up] = {}
                pairs[up][idx] = digest
                if up == 0:
                    waiting.append((n, idx, digest, more))
            if len(out) > 2000:
                yield made()
        if block is not None:
            settle()
        if out:
            yield made()

    return run


@dataclass
class Manifest:
    """The leaves of a table with the paths to its root, and the root, None for an empty table."""

    paths: DataFrame
    root: str | None


def manifest(docs: DataFrame, step: int = STEP) -> Manifest:
    """Trees over docs(doc_id, source, lang, n_chars, text), a tree a language and one over these.

    Rows of a language are in order of doc_id, null first, rows of one id in that of their
    digests; languages in that of their bytes, null first. Null and empty texts have digests like
    others; repeated rows are leaves each; other columns are not read.
    """
    leaves, _ = numbered(stored(leaves_of(docs), "leaves"), ["doc_id", "digest", "spread"])
    by_lang = grow(leaves, step)
    tops = stored(by_lang.tops(), "subroots")
    langs, used = numbered(tops.select(F.lit("").alias("key"), F.col("key").alias("lang"), "digest", "leaves"), ["lang"])
    over = grow(langs, step)
    top = over.tops().first()
    none = F.lit("").alias("path")
    steps = scan_paths(over, over.tops().select("key", "leaves", "digest", none))
    above = stored(steps.select(F.col("lang").alias("key"), "leaves", "digest", "path"), "above")
    discard(tops, used)
    return Manifest(scan_paths(by_lang, above), top and top["digest"])


def fold(digest: str, path: str) -> str:
    """The root that a path leads a leaf to."""
    for step in path.split(",") if path else ():
        digest = sha(digest if step == "." else step[1:] + digest if step[0] == "L" else digest + step[1:])
    return digest


def verified_manifest(docs: DataFrame, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs:
    each leaf folded along its proof, rows of every seventh id or so after they were changed.

    Rows as in manifest(); an n_chars that is null stays so; null ids are never changed. An empty table gives none.
    """
    found = manifest(docs, step)
    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids, leaves, others, subroots, paths = batch.columns
            proofs, folded = [], []
            for leaf, other, path in zip(leaves.to_pylist(), others.to_pylist(), paths.to_pylist()):
                proofs.append(sha("".join(step[1:] for step in path.split(","))))
                folded.append(fold(other or leaf, path))
            yield pa.RecordBatch.from_arrays([ids, leaves, subroots, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=names)

    out = map_batches(found.paths.select("doc_id", "digest", "other", "subroot", "path"), run, schema)
    root = F.lit(found.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
