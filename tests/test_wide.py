import numpy as np
import pytest

from stratalog.config import AnomalyConfig
from stratalog.operators import scoring, wide


def counts_of(spark, x):
    rows = [(int(w), f"t{j:06d}", float(v)) for w, row in enumerate(x) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "Window long, EventTemplate string, cnt double").repartition(4)


def low_rank(n, p, k, seed):
    """Counts driven by k causes, with noise, and two windows out of the pattern."""
    rng = np.random.default_rng(seed)
    x = np.round(np.maximum(rng.gamma(2, 3, (n, k)) @ rng.gamma(0.4, 1, (k, p)) + rng.normal(0, 0.7, (n, p)), 0))
    x[5, : p // 2] += 9
    x[11] = x[11][::-1]
    return x


@pytest.mark.parametrize("n, p, config", [(90, 12, AnomalyConfig(variance_threshold=0.8)), (40, 60, AnomalyConfig()), (120, 180, AnomalyConfig(variance_threshold=0.6, use_scaling=False))])
def test_as_the_square_matrix_gives(spark, monkeypatch, n, p, config):
    counts = counts_of(spark, low_rank(n, p, 4, n))
    want = {r.Window: r for r in scoring.score_windows(counts, config).collect()}
    monkeypatch.setattr(scoring, "MOST_FEATURES", 3)
    got = {r.Window: r for r in scoring.score_windows(counts, config).collect()}
    scale = max(r.AnomalyScore for r in want.values())
    assert set(got) == set(want) and all(abs(got[w].AnomalyScore - want[w].AnomalyScore) <= 1e-5 * scale for w in want)
    if p <= wide.PROBES:
        assert all(got[w].IsAnomaly == want[w].IsAnomaly for w in want)


def test_moments_are_near(spark):
    x = low_rank(150, 400, 5, 3)
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = (x - mean) / dev
    values = np.linalg.eigvalsh(z.T @ z / 149)[::-1]
    vectors = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)], "Window long, ids array<int>, values array<double>")
    c = wide.Covariance(vectors, 400, 150, mean, dev)
    found, axes = wide.leading(c, float(values.sum()), 0.5, 150)
    kept = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.5) + 1)
    assert len(found) == kept and np.allclose(found, values[:kept], rtol=1e-6)
    t2, t3 = wide.residual_moments(c, axes)
    assert abs(t2 / (values[kept:] ** 2).sum() - 1) < 0.1 and abs(t3 / (values[kept:] ** 3).sum() - 1) < 0.25


def test_hundred_thousand_features(spark):
    rng = np.random.default_rng(1)
    rows = [(w, f"t{j:06d}", float(rng.integers(1, 9))) for w in range(60) for j in {*rng.integers(0, 100_000, 1700).tolist(), *range(20)}]
    rows += [(60, f"t{j:06d}", 5.0) for j in range(100_000)]
    got = scoring.score_windows(spark.createDataFrame(rows, "Window long, EventTemplate string, cnt double"), AnomalyConfig(variance_threshold=0.3)).collect()
    assert len(got) == 61 and all(np.isfinite(r.AnomalyScore) and r.AnomalyScore >= 0 for r in got)


def test_degenerate(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_FEATURES", 0)
    same = [(w, t, 2.0) for w in range(5) for t in "abc"]
    for rows in (same, same[:3], same[:1]):
        got = scoring.score_windows(spark.createDataFrame(rows, "Window int, EventTemplate string, cnt double"), AnomalyConfig()).collect()
        assert all(r.AnomalyScore == 0 and not r.IsAnomaly for r in got) and len(got) == len({r[0] for r in rows})
    assert scoring.score_windows(spark.createDataFrame([], "Window int, EventTemplate string, cnt double"), AnomalyConfig()).count() == 0
