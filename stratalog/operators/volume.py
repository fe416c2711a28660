"""Volume windows of a stream, found side by side in blocks of its rows.

Where a window ends decides where the next begins: a chain through the positions of a stream.
How far a window goes from any position follows from a few ranks of times, which scans give. So
a block of positions tells, for each of them, where a chain that meets it leaves the block;
chains that enter at like places leave at like ones, and few such places remain. Of these,
pointer doubling marks those that the chain from the first row passes, and every block walks
its own part of the chain from there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.scans import kept, numbered, scan

#: Rows of a block.
BLOCK = 200_000

_RANKS = ["lower", "up", "below_least", "to_least", "to_most", "n"]


def time_ranks(times: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """(key, us, lower, up, below_least, to_least, to_most, n) for each distinct time of
    times(key, _us): how many rows of the key are before it and up to it, before us + least, up to
    that and up to us + most, and in all. Times and these bounds are merged in order."""
    own = times.groupBy(F.col(key).alias("key"), F.col("_us").alias("us")).agg(F.count("*").alias("c"))
    own = kept(own, "times")
    zero = F.lit(0).cast("long").alias("c")
    marks = [
        own.select("key", "us", F.col("us").alias("at"), F.lit(1).alias("side"), F.lit("up").alias("of"), "c"),
        own.select("key", "us", (F.col("us") + least).alias("at"), F.lit(0).alias("side"), F.lit("below_least").alias("of"), zero),
        own.select("key", "us", (F.col("us") + least).alias("at"), F.lit(2).alias("side"), F.lit("to_least").alias("of"), zero),
        own.select("key", "us", (F.col("us") + most).alias("at"), F.lit(2).alias("side"), F.lit("to_most").alias("of"), zero),
    ]
    ranked = scan(reduce(DataFrame.unionByName, marks), ["at", "side"], {"rank": "c"}, ["key"])
    of = lambda name: F.max(F.when(F.col("of") == name, F.col("rank"))).alias(name)
    found = ranked.groupBy("key", "us").agg(*map(of, ("up", "below_least", "to_least", "to_most")), F.max("c").alias("c"))
    total = own.groupBy("key").agg(F.sum("c").alias("n"))
    return found.join(total, "key").select("key", "us", (F.col("up") - F.col("c")).alias("lower"), *_RANKS[1:])


class _Block:
    """The positions of one block and the ranks of the times that they have."""

    def __init__(self, block: int, size: int, rows: pd.DataFrame, target: int):
        rows = rows.sort_values("lower")
        self.us = rows["us"].to_numpy(np.int64)
        self.lower, _, self.below, self.least, self.most, n = (rows[c].to_numpy(np.int64) for c in _RANKS)
        self.n, self.target, self.start = int(n[0]), target, block * size
        self.end = min(self.start + size, self.n)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(time, first row, row after the last, next start) of the windows that start at positions."""
        r = np.searchsorted(self.lower, at, "right") - 1
        to = np.minimum(at + self.target, self.n)
        short, long = to - 1 < self.below[r], to - 1 >= self.most[r]
        to_least = short & ((to < self.n) | long)
        by_time = to_least | long
        first = np.where(by_time, self.lower[r], at)
        end = np.where(to_least, self.least[r], np.where(long, self.most[r], to))
        return self.us[r], first, end, at + end - first

    def exits(self) -> np.ndarray:
        """For each position, the first of its chain beyond the block: jumps of double length."""
        out = self.windows(np.arange(self.start, self.end))[3]
        while len(inside := np.flatnonzero(out < self.end)):
            out[inside] = out[out[inside] - self.start]
        return out

    def walk(self, at: int) -> list[tuple[int, int, int, int]]:
        out = []
        while at < self.end:
            us, first, end, after = (int(x[0]) for x in self.windows(np.array([at])))
            out.append((us, first, end - 1, at))
            at = after
        return out


def volume_windows(times: DataFrame, key: str, target: int, least: int, most: int, block: int = BLOCK) -> DataFrame:
    """(key, _w, _a, _b, _at, _nth) of times(key, _us): start time, first and last row of each window, rows
    being numbered from 0 in order of time, the row that it starts at, and its number. least and
    most are microseconds."""
    kind = dict(times.dtypes)[key]
    ranks = kept(time_ranks(times, key, least, most), "ranks")
    parts = F.sequence(F.expr(f"lower div {block}"), F.expr(f"(up - 1) div {block}"))
    blocks = kept(ranks.withColumn("block", F.explode(parts)), "blocks")
    none = [F.lit(None).cast("long").alias(c) for c in ("us", *_RANKS)]
    longest = ranks.agg(F.max("n")).first()[0] or 0

    def at_nodes(nodes: DataFrame) -> DataFrame:
        """Blocks and the nodes(key, x) in them, to be met by (key, block)."""
        placed = nodes.select("key", *none, F.expr(f"x div {block}").alias("block"), "x")
        return blocks.select("key", "us", *_RANKS, "block", F.lit(None).cast("long").alias("x")).unionByName(placed).groupBy("key", "block")

    def of(group: pd.DataFrame) -> tuple[_Block, np.ndarray]:
        known = group[group["x"].isna()]
        return _Block(int(group["block"].iloc[0]), block, known, target), np.unique(group["x"].dropna().to_numpy(np.int64))

    def leave(group: pd.DataFrame) -> pd.DataFrame:
        found = _Block(int(group["block"].iloc[0]), block, group, target)
        x = np.unique(found.exits())
        return pd.DataFrame({"key": group["key"].iloc[0], "x": x[x < found.n]})

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        found, x = of(group)
        y = found.exits()[x - found.start]
        return pd.DataFrame({"key": group["key"].iloc[0], "x": x, "y": y})[y < found.n]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        found, x = of(group)
        rows = [w for at in x.tolist() for w in found.walk(at)]
        return pd.DataFrame(rows, columns=["_w", "_a", "_b", "_at"]).assign(key=group["key"].iloc[0])

    passed = kept(ranks.select("key").distinct().withColumn("x", F.lit(0).cast("long")), "passed")
    if longest > block:
        left = blocks.groupBy("key", "block").applyInPandas(leave, f"key {kind}, x long").distinct()
        jumps = kept(at_nodes(left.union(passed).distinct()).applyInPandas(follow, f"key {kind}, x long, y long"), "jumps")
        for _ in range((longest // block).bit_length()):
            passed = kept(passed.union(passed.join(jumps, ["key", "x"]).select("key", "y")).distinct(), "passed")
            jumps = kept(jumps.join(jumps.select("key", F.col("x").alias("y"), F.col("y").alias("z")), ["key", "y"]).select("key", "x", F.col("z").alias("y")), "jumps")
    found = at_nodes(passed).applyInPandas(walk, f"_w long, _a long, _b long, _at long, key {kind}")
    return numbered(found, ["_at"], "_nth", ["key"]).select(F.col("key").alias(key), "_w", "_a", "_b", "_at", "_nth")
