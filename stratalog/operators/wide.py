"""Scores of windows with more templates than a square matrix of them can hold.

Nothing here is of size p x p. The covariance is applied to a few vectors at a time by a pass
over the sparse windows; its leading axes are those of a block of vectors that it was
applied to until they rest; and the moments of what is left over, which the limit needs, are
estimated from what it does to random signs. For few features the signs are all unit
vectors, and the moments exact.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.config import AnomalyConfig

#: Vectors that iteration begins with and has beyond those that are kept, numbers that a block
#: of vectors has at most (they go to the driver and to all tasks), passes at most, relative
#: change of the axes' variances at which they rest, and random vectors for moments.
FIRST, SPARE, MOST_CELLS, PASSES, AT_REST, PROBES = 24, 8, 32_000_000, 40, 1e-9, 64

_log = logging.getLogger("stratalog")


@dataclass
class WideModel:
    """As PcaModel, for sparse windows."""

    mean: np.ndarray
    deviation: np.ndarray
    axes: np.ndarray
    limit: float

    def prepared(self) -> tuple[np.ndarray, float, np.ndarray]:
        scaled = self.axes / self.deviation[:, None]
        shift = self.mean / self.deviation
        return scaled, float(shift @ shift), self.mean @ scaled

    def scores(self, ids: list, values: list, ready: tuple) -> np.ndarray:
        """Scores of sparse windows; ready: what prepared() gave."""
        scaled, origin, offset = ready
        out = np.zeros(len(ids))
        for k, (i, x) in enumerate(zip(ids, values)):
            i, x = np.asarray(i, np.int64), np.asarray(x, float)
            z, shift = (x - self.mean[i]) / self.deviation[i], self.mean[i] / self.deviation[i]
            inside = x @ scaled[i] - offset
            out[k] = origin + z @ z - shift @ shift - inside @ inside
        return np.maximum(out, 0.0)


def feature_sums(vectors: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(windows, sums, sums of squares): p rows reach the driver."""
    each = vectors.select(F.explode(F.arrays_zip("ids", "values")).alias("v")).select("v.ids", "v.values")
    found = each.groupBy("ids").agg(F.sum("values").alias("s"), F.sum(F.col("values") * F.col("values")).alias("q")).toPandas()
    sums, squares = np.zeros(p), np.zeros(p)
    sums[found["ids"]], squares[found["ids"]] = found["s"], found["q"]
    return vectors.count(), sums, squares


class Covariance:
    """The covariance of standardised windows, as a map of blocks of vectors."""

    def __init__(self, vectors: DataFrame, p: int, n: int, mean: np.ndarray, deviation: np.ndarray):
        self.vectors, self.p, self.n, self.mean, self.deviation = vectors, p, n, mean, deviation

    def __call__(self, block: np.ndarray) -> np.ndarray:
        """The covariance times block (p x m). Each task adds up its windows' parts, which are added
        up by feature."""
        m, p = block.shape[1], self.p
        sent = self.vectors.sparkSession.sparkContext.broadcast((block / self.deviation[:, None]).astype(np.float64))
        offset = self.mean @ sent.value

        def partial(batches):
            scaled, total, along = sent.value, np.zeros((p, m)), np.zeros(m)
            touched = np.zeros(p, bool)
            for batch in batches:
                for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    i, x = np.asarray(i, np.int64), np.asarray(x, float)
                    y = x @ scaled[i] - offset
                    total[i] += x[:, None] * y
                    touched[i] = True
                    along += y
            at = np.flatnonzero(touched)
            for k in range(0, len(at), 5000):
                some = at[k : k + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["i", "row"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([along], pa.list_(pa.float64()))], names=["i", "row"])

        rows = self.vectors.select("ids", "values").mapInArrow(partial, "i long, row array<double>")

        def add(batches):
            held = {}
            for batch in batches:
                for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held[i] = held[i] + np.array(row) if i in held else np.array(row)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["i", "row"])

        products, along = np.zeros((p, m)), np.zeros(m)
        for r in rows.repartition("i").mapInArrow(add, rows.schema).toLocalIterator():
            if r.i < 0:
                along = np.array(r.row)
            else:
                products[r.i] = r.row
        sent.unpersist()
        return (products - np.outer(self.mean, along)) / self.deviation[:, None] / (self.n - 1)


def leading(covariance: Covariance, total: float, share: float, rank: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(variances, axes) of the fewest axes that have the share of the total variance."""
    rng = np.random.default_rng(seed)
    most = max(1, min(rank, covariance.p, MOST_CELLS // covariance.p))
    basis, m, before = np.zeros((covariance.p, 0)), min(FIRST + SPARE, most), None
    for _ in range(PASSES):
        if basis.shape[1] < m:
            basis = np.linalg.qr(np.concatenate([basis, rng.standard_normal((covariance.p, m - basis.shape[1]))], axis=1))[0]
            before = None
        image = covariance(basis)
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        axes = basis @ turn
        reached = np.cumsum(values) >= share * total * (1 - 1e-12)
        kept = int(np.argmax(reached)) + 1 if reached.any() else len(values)
        enough = reached.any() and (kept + SPARE <= m or m == most)
        if m == covariance.p or enough and before is not None and np.abs(values[:kept] - before[:kept]).max() <= AT_REST * total:
            return values[:kept], axes[:, :kept]
        if m < most and not enough and (before is not None or not reached.any()):
            m = min(2 * m, most)
        before = values
        basis = np.linalg.qr(image)[0]
    if not reached.any():
        _log.warning("%d axes have less than the share of variance that is asked for", kept)
    return values[:kept], axes[:, :kept]


def residual_moments(covariance: Covariance, axes: np.ndarray, seed: int = 6) -> tuple[float, float]:
    """Sums of the squared and cubed variances outside the axes: exact for up to PROBES features."""
    p = covariance.p
    signs = np.eye(p) if p <= PROBES else np.random.default_rng(seed).choice([-1.0, 1.0], (p, PROBES))
    out = lambda x: x - axes @ (axes.T @ x)
    once = out(covariance(out(signs)))
    twice = out(covariance(once))
    each = 1.0 if p <= PROBES else 1 / PROBES
    return float((once * once).sum() * each), float((once * twice).sum() * each)


def fit_wide(vectors: DataFrame, p: int, config: AnomalyConfig, limit) -> WideModel | None:
    """The model of vectors(Window, ids, values); None for fewer than two windows. limit: makes the
    limit of the sums of residual variances, their squares and cubes."""
    n, sums, squares = feature_sums(vectors, p)
    if n < 2:
        return None
    mean = sums / n
    var = np.maximum(squares / n - mean**2, 0)
    deviation = np.where(config.use_scaling & (var > 1e-24), np.sqrt(var), 1.0)
    total = float((var / deviation**2).sum()) * n / (n - 1)
    covariance = Covariance(vectors, p, n, mean, deviation)
    values, axes = leading(covariance, total, config.variance_threshold, min(n, p)) if total > 0 else (np.zeros(1), np.zeros((p, 1)))
    rest = max(total - float(values.sum()), 0.0)
    t2, t3 = residual_moments(covariance, axes) if rest > 1e-8 else (0.0, 0.0)
    return WideModel(mean, deviation, axes, limit(rest, t2, t3, config.alpha))


def score_wide(vectors: DataFrame, model: WideModel | None, kind: str) -> DataFrame:
    """(Window, AnomalyScore, IsAnomaly) of vectors; 0 and unflagged without a model."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        ready = m and m.prepared()
        for batch in batches:
            s = m.scores(batch.column(1).to_pylist(), batch.column(2).to_pylist(), ready) if m else np.zeros(batch.num_rows)
            flag = s > m.limit if m else np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(flag)], names=["Window", "AnomalyScore", "IsAnomaly"])

    return vectors.mapInArrow(score, f"Window {kind}, AnomalyScore double, IsAnomaly boolean")
