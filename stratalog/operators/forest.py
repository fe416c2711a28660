"""Isolation forest over the windows' counts: windows that random cuts soon leave alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.config import AnomalyConfig
from stratalog.operators.scans import kept, quantiles
from stratalog.operators.scoring import _dictionary, _vectors, register, tfidf

#: Trees, windows that a tree is grown from, the share of windows that is flagged, and cells of
#: the counts that a task lays out at once.
TREES, SAMPLE, CONTAMINATION, CELLS = 100, 256, 0.1, 4_000_000

_TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def expected_depth(n: int) -> float:
    """Mean depth at which a search in a random tree of n ends."""
    if n <= 2:
        return float(max(n - 1, 0))
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, cut, left, right, depth of a leaf) of a tree over the rows of x: a
    random feature that differs, cut at random between its extremes, up to log2 of the rows."""
    deepest = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, todo = [None], [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        differ = np.flatnonzero(high > low)
        if depth == deepest or not len(differ):
            nodes[at] = (-1, 0.0, -1, -1, depth + expected_depth(len(rows)))
            continue
        f = int(rng.choice(differ))
        cut = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        todo += [(len(nodes), rows[below], depth + 1), (len(nodes) + 1, rows[~below], depth + 1)]
        nodes += [None, None]
    return nodes


def samples(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """(tree, ids, values): at most SAMPLE windows for each tree, those with the least hashes."""
    likely = min(1.0, (SAMPLE + 6 * SAMPLE**0.5 + 10) / max(n, 1))
    hash_of = lambda t: F.xxhash64("Window", t, F.lit(seed))
    trees = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.pmod(hash_of(t), F.lit(1 << 31)) < F.lit(int(likely * (1 << 31))))
    each = vectors.select("Window", "ids", "values", F.explode(trees).alias("tree"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(hash_of(F.col("tree")), "Window"))
    return each.withColumn("_place", place).where(F.col("_place") <= SAMPLE).select("tree", "_place", "ids", "values")


def fit_forest(vectors: DataFrame, n: int, seed: int = 42) -> list:
    """The trees of vectors(Window, ids, values), each grown by a task from its sample."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place")
        tree = int(group["tree"].iloc[0])
        features = np.unique(np.concatenate([np.asarray(i, np.int64) for i in group["ids"]]))
        x = np.zeros((len(group), len(features)))
        for row, i, v in zip(x, group["ids"], group["values"]):
            row[np.searchsorted(features, i)] = v
        nodes = grow_tree(x, np.random.default_rng([seed, tree]))
        feature, cut, left, right, depth = map(list, zip(*nodes))
        feature = [int(features[f]) if f >= 0 else -1 for f in feature]
        return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut], "left": [left], "right": [right], "depth": [depth]})

    found = samples(vectors, n, seed).groupBy("tree").applyInPandas(fit, _TREE).collect()
    return [[np.array(r[c]) for c in ("feature", "cut", "left", "right", "depth")] for r in sorted(found, key=lambda r: r.tree)]


def depths(x: np.ndarray, tree: list, column: np.ndarray) -> np.ndarray:
    """Depth at which each row of x ends; column: the column of a feature in x."""
    feature, cut, left, right, depth = tree
    node = np.zeros(len(x), np.int64)
    while len(on := np.flatnonzero(feature[node] >= 0)):
        f = node[on]
        node[on] = np.where(x[on, column[feature[f]]] <= cut[f], left[f], right[f])
    return depth[node]


def score_forest(vectors: DataFrame, trees: list, sample: int, kind: str) -> DataFrame:
    """(Window, AnomalyScore): 2 to the power of minus the mean depth over that expected."""
    used = np.unique(np.concatenate([t[0][t[0] >= 0] for t in trees]))
    shared = vectors.sparkSession.sparkContext.broadcast((trees, used))
    norm = expected_depth(sample)

    def score(batches):
        trees, used = shared.value
        column = np.full(int(used.max()) + 1 if len(used) else 1, -1)
        column[used] = np.arange(len(used))
        step = max(1, CELLS // max(len(used), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.zeros((part.num_rows, len(used)))
                for row, i, v in zip(x, part.column(1).to_pylist(), part.column(2).to_pylist()):
                    i, v = np.asarray(i, np.int64), np.asarray(v, float)
                    seen = np.isin(i, used)
                    row[column[i[seen]]] = v[seen]
                mean = sum(depths(x, t, column) for t in trees) / len(trees)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(2.0 ** (-mean / norm))], names=["Window", "AnomalyScore"])

    return vectors.mapInArrow(score, f"Window {kind}, AnomalyScore double")


def isolation_forest(counts: DataFrame, config: AnomalyConfig) -> DataFrame:
    """(Window, AnomalyScore, IsAnomaly) of counts(Window, EventTemplate, cnt), from 0 to 1; windows
    with a score above the (1 - CONTAMINATION) quantile of all are flagged.

    Trees are grown from bounded samples and are few, so they go to all tasks; every window is
    scored. With fewer than two windows the score is 0 and nothing is flagged.
    """
    kind = dict(counts.dtypes)["Window"]
    dictionary, _ = _dictionary(counts)
    features = counts.select("Window", F.col("EventTemplate").alias("feature"), F.col("cnt").cast("double").alias("value"))
    vectors = kept(_vectors(tfidf(features) if config.use_tfidf else features, dictionary, False), "vectors")
    n = vectors.count()
    if n < 2:
        return vectors.select("Window", F.lit(0.0).alias("AnomalyScore"), F.lit(False).alias("IsAnomaly"))
    scores = kept(score_forest(vectors, fit_forest(vectors, n), min(SAMPLE, n), kind), "scores")
    limit = quantiles(scores.withColumn("_all", F.lit(0)), "_all", "AnomalyScore", [1 - CONTAMINATION]).select(F.col("value").alias("_limit"))
    flagged = scores.crossJoin(F.broadcast(limit))
    return flagged.select("Window", "AnomalyScore", (F.col("AnomalyScore") > F.col("_limit")).alias("IsAnomaly"))


register("isolation_forest", isolation_forest)
