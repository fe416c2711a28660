"""What several operators share: the shared folder, text batches, connected components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows that a task turns into python objects at once, bytes of a batch that goes to it,
#: edges that a task joins into components at once, and short rows that one task may write.
SLICE_ROWS, BATCH_BYTES, EDGES, PART_ROWS = 1000, 8 << 20, 200_000, 200_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Only where the setting is missing and all runs in one process (tests) is a temporary
    folder made; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def counted(df: DataFrame, kind: str, **seen) -> tuple[DataFrame, dict]:
    """stored(df, kind), and what was seen as it was written: its number of rows, as "rows",
    and the given aggregates."""
    watch = Observation()
    columns = [c.alias(k) for k, c in {"rows": F.count(F.lit(1)), **seen}.items()]
    return stored(df.observe(watch, *columns), kind), watch.get


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many short rows, in no more partitions than these are worth (but one a
    core): each file that is written costs an executor buffers and, on local file systems,
    several processes forked off its JVM, however few rows the file has."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() gave, once nothing that is still to run reads them."""
    for table in tables:
        if path := _folders.pop(table, None):
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes (texts can be long, and what a batch holds
    is in memory several times over) and buffers given back when a task ends: its Python
    worker lives on. Spark reads the bound when the plan runs, so it stays set in the session,
    unless the session has its own."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def row_key(docs: DataFrame) -> list:
    """(id, row) of a row of docs(doc_id, text), for a row's own identity: rows with equal ids
    and equal texts are one, all others differ, those without id too. Null ids are last in
    order."""
    doc_id = docs["doc_id"].cast("long")
    return [F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(doc_id, docs["text"]).alias("row")]


#: Columns of documents that stages which keep all columns read or write.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a stage that gives rows of its first argument with all their columns: it sees further
    columns under plain names of their own, and whatever they are called (dots, names
    that differ in case only) comes back."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        names = docs.columns
        own = [n if n in DOCUMENT_COLUMNS and names.index(n) == i else f"other_{i}" for i, n in enumerate(names)]
        return stage(docs.toDF(*own), *args, **named).toDF(*names)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_text(
    docs: DataFrame,
    columns: list[str],
    schema: str,
    per_batch: Callable[[list], Iterator[pa.RecordBatch]],
    done: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Apply per_batch(one python list per column) to slices of the Arrow batches: of a batch
    that may hold many texts, few are python objects at a time. done: called as a task ends."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield from per_batch([part.column(i).to_pylist() for i in range(len(columns))])
        done()

    return map_batches(docs.select(*columns), run, schema)


def _roots(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The least node of its component, of each node that is not it."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


_EDGES = "u long, v long, own boolean, split boolean"


def _contract(batches: Iterator, is_sorted: bool) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, own, split): v is the least node that the edges of a block connect u with.

    In input that is sorted by u, a block ends with the rows of a u; own marks the one row of
    a u that edges start from, split a u that had several ends."""
    held: list[tuple[int, int]] = []

    def flush():
        several = {a for (a, b), (c, d) in zip(held, held[1:]) if a == c and b != d} if is_sorted else set()
        starts = {a for a, _ in held} if is_sorted else set()
        found = _roots(held)
        held.clear()
        rows = [(u, v, u in starts, u in several) for u, v in found.items()]
        columns = zip(*rows) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["u", "v", "own", "split"])

    for batch in batches:
        for edge in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(held) >= EDGES and (not is_sorted or edge[0] != held[-1][0]):
                yield flush()
            held.append(edge)
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node whose component has a smaller one: root is its smallest.

    edges: columns u and v, long. Distributed union-find: each task joins what its edges
    connect, block by block, and keeps an edge from every node to the least one it knows. Then
    edges meet by their larger end, of which each task has given one row at most, until every
    node has one such edge (with steps by which it takes its parent's); then parents are
    followed, path lengths halving, until all are roots. What is shuffled is a row a node; a
    root with very many nodes is met only by the join with the parents, both sides of which
    are plain shuffles of stored tables, so that Spark splits it. A table is written after
    each step: lost executors cost one step. Steps never add rows, so the number of those
    before says how many tasks one is worth.
    """

    def narrow(batches):
        return _contract(batches, False)

    def by_node(batches):
        return _contract(batches, True)

    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    cur, seen = counted(map_batches(down, narrow, _EDGES), "edges")
    n_rows = seen["rows"]
    is_forest = False
    while True:
        if not is_forest:
            meet = in_few_parts(cur.select("u", "v").repartition("u"), n_rows).sortWithinPartitions("u", "v")
            after, seen = counted(map_batches(meet, by_node, _EDGES), "edges", several=n(F.col("split")))
            discard(cur)
            n_rows = seen["rows"]
            cur, is_forest = after, not seen["several"]
        parents = cur.where("own").select(F.col("u").alias("p"), F.col("v").alias("up"))
        step = cur.select("u", "v").join(parents, F.col("v") == F.col("p"), "left")
        step = step.select("u", F.coalesce("up", "v").alias("v"), F.lit(True).alias("own"), F.col("up").isNotNull().alias("moved"))
        after, seen = counted(in_few_parts(step, n_rows), "edges", moved=n(F.col("moved")))
        discard(cur)
        cur = after
        if is_forest and not seen["moved"]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))

