"""Anomaly scores of windows: the residual of their counts outside the principal subspace."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.config import AnomalyConfig
from stratalog.operators.matrix import feature_dictionary
from stratalog.operators.scans import kept
from stratalog.operators.wide import fit_wide, score_wide

#: Templates up to which the p x p matrix of a model is held by the driver and each task.
MOST_FEATURES = 4096


def tfidf(features: DataFrame) -> DataFrame:
    """(Window, feature, value) with value turned into tf * (ln((1 + n) / (1 + df)) + 1), the
    windows' vectors at unit length."""
    n = features.select("Window").distinct().agg(F.count("*").alias("_n"))
    df = features.where("value <> 0").groupBy("feature").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n))
    idf = df.select("feature", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    raw = features.join(idf, "feature").withColumn("value", F.col("value") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("Window")))
    return raw.withColumn("_norm", norm).select(
        "Window", "feature", F.when(F.col("_norm") > 0, F.col("value") / F.col("_norm")).otherwise(0.0).alias("value")
    )


def moments(features: DataFrame) -> DataFrame:
    """(feature, mean, deviation) over all windows, absent values being 0; deviations are of
    the population, 1 where there is none."""
    n = features.select("Window").distinct().agg(F.count("*").alias("_n"))
    sums = features.groupBy("feature").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    var = F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))
    out = sums.crossJoin(F.broadcast(n)).select("feature", mean.alias("mean"), F.sqrt(var).alias("_d"))
    return out.select("feature", "mean", F.when(F.col("_d") > 1e-12, F.col("_d")).otherwise(1.0).alias("deviation"))


def standardised(features: DataFrame) -> DataFrame:
    """Stored (non-zero) values as (value - mean) / deviation."""
    joined = features.join(moments(features), "feature")
    return joined.select("Window", "feature", ((F.col("value") - F.col("mean")) / F.col("deviation")).alias("value"))


@dataclass
class PcaModel:
    """score(x) = |(x - mean) / deviation|^2 minus its part in the subspace; flagged above limit."""

    mean: np.ndarray
    deviation: np.ndarray
    axes: np.ndarray
    limit: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        inside = z @ self.axes
        return np.maximum((z * z).sum(1) - (inside * inside).sum(1), 0.0)


def residual_limit(eigenvalues: np.ndarray, kept: int, alpha: float) -> float:
    """limit_of_moments of the variances beyond those kept."""
    rest = eigenvalues[kept:]
    if not len(rest) or np.allclose(rest, 0):
        return float("inf")
    return limit_of_moments(*(float((rest**i).sum()) for i in (1, 2, 3)), alpha)


def limit_of_moments(t1: float, t2: float, t3: float, alpha: float) -> float:
    """Jackson-Mudholkar limit of the squared residual at level alpha, from the sums of the residual
    variances, their squares and cubes; infinite where the residual has no spread to speak of."""
    if t2 <= 0:
        return float("inf")
    h = 1 - 2 * t1 * t3 / (3 * t2 * t2)
    if h <= 0:
        return float("inf")
    z = NormalDist().inv_cdf(1 - alpha)
    base = 1 + z * np.sqrt(2 * t2 * h * h) / t1 + t2 * h * (h - 1) / t1**2
    with np.errstate(invalid="ignore"):
        return float(t1 * np.power(base, 1 / h))


def subspace(covariance: np.ndarray, rank: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, axes, number kept): the fewest axes that explain the share of variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:rank], 0), vectors[:, ::-1][:, :rank]
    total = values.sum()
    ratio = np.cumsum(values) / total if total > 0 else np.full(len(values), np.nan)
    kept = 1 if np.isnan(ratio).all() else int(np.searchsorted(ratio, share) + 1)
    kept = min(max(kept, 1), len(values))
    return values, vectors[:, :kept], kept


def _vectors(features: DataFrame, dictionary: DataFrame, few: bool = True) -> DataFrame:
    """(Window, ids, values): each window's sparse vector."""
    placed = features.join(F.broadcast(dictionary) if few else dictionary, "feature")
    pairs = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    return placed.groupBy("Window").agg(pairs.alias("_v")).select(
        "Window", F.col("_v.feature_id").alias("ids"), F.col("_v.value").cast("array<double>").alias("values")
    )


def _dense(ids: list, values: list, p: int) -> np.ndarray:
    out = np.zeros((len(ids), p))
    for row, i, v in zip(out, ids, values):
        row[i] = v
    return out


def _gram(vectors: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, p x p products) over all windows: each task adds up its own and gives one row
    per feature, which are then added up by feature; p rows reach the driver."""

    def partial(batches):
        n, total = 0, np.zeros((p, p + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _dense(part.column(0).to_pylist(), part.column(1).to_pylist(), p)
                total[:, :p] += x.T @ x
                total[:, p] += x.sum(0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(p), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64())), "n": pa.array([n] * p, pa.int64())}
            )

    rows = vectors.select("ids", "values").mapInArrow(partial, "i int, row array<double>, n long")

    def add(key, group):
        return group.iloc[:1].assign(row=[np.sum(np.stack(group["row"]), axis=0)], n=group["n"].sum())

    found = sorted(rows.groupBy("i").applyInPandas(add, rows.schema).collect(), key=lambda r: r.i)
    if not found:
        return 0, np.zeros(p), np.zeros((p, p))
    both = np.array([r.row for r in found])
    return int(found[0].n), both[:, p], both[:, :p]


def fit_pca(vectors: DataFrame, p: int, config: AnomalyConfig) -> PcaModel | None:
    """The model of all windows' vectors; None for fewer than two windows or no features."""
    if not p:
        return None
    return model_of(*_gram(vectors, p), config)


def model_of(n: int, sums: np.ndarray, products: np.ndarray, config: AnomalyConfig) -> PcaModel | None:
    """The model of n windows with these sums of counts and of their products."""
    if n < 2:
        return None
    p, mean = len(sums), sums / n
    var = np.maximum(products.diagonal() / n - mean**2, 0)
    deviation = np.where(config.use_scaling & (var > 1e-24), np.sqrt(var), 1.0)
    covariance = (products - n * np.outer(mean, mean)) / (n - 1) / np.outer(deviation, deviation)
    values, axes, kept = subspace(covariance, min(n, p), config.variance_threshold)
    return PcaModel(mean, deviation, axes, residual_limit(values, kept, config.alpha))


def _dictionary(counts: DataFrame) -> tuple[DataFrame, int]:
    """(feature, feature_id) and their number."""
    dictionary = feature_dictionary(counts).withColumnRenamed("EventTemplate", "feature")
    return dictionary, dictionary.count()


def _scored(vectors: DataFrame, model: PcaModel | None, p: int, kind: str) -> DataFrame:
    """Scores of sparse vectors by a broadcast model; 0 and unflagged without one."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, m = batch.slice(at, 1024), shared.value
                if m is None:
                    s = np.zeros(part.num_rows)
                    flag = np.zeros(part.num_rows, bool)
                else:
                    s = m.scores(_dense(part.column(1).to_pylist(), part.column(2).to_pylist(), p))
                    flag = s > m.limit
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array(flag)], names=["Window", "AnomalyScore", "IsAnomaly"]
                )

    return vectors.mapInArrow(score, f"Window {kind}, AnomalyScore double, IsAnomaly boolean")


def score_windows(counts: DataFrame, config: AnomalyConfig) -> DataFrame:
    """(Window, AnomalyScore, IsAnomaly) of the windows in counts(Window, EventTemplate, cnt).

    Two passes over the long form: sums and products, then scores; with more than MOST_FEATURES
    templates some passes more, but no square matrix of them. Without features or with
    one window the score is 0 and nothing is flagged; an empty table stays empty.
    """
    dictionary, p = _dictionary(counts)
    features = counts.select("Window", F.col("EventTemplate").alias("feature"), F.col("cnt").cast("double").alias("value"))
    vectors = _vectors(tfidf(features) if config.use_tfidf else features, dictionary, p <= MOST_FEATURES)
    if p > MOST_FEATURES:
        vectors = kept(vectors, "vectors")  # read by each pass
        return score_wide(vectors, fit_wide(vectors, p, config, limit_of_moments), dict(counts.dtypes)["Window"])
    return _scored(vectors, fit_pca(vectors, p, config), p, dict(counts.dtypes)["Window"])


@dataclass
class FittedDetector:
    """A model with the templates that it knows: fitted once, kept as JSON, applied to later
    windows batch by batch. Templates that it does not know are left out of a window."""

    templates: list[str]
    model: PcaModel

    def to_json(self) -> str:
        m = self.model
        return json.dumps(
            {"templates": self.templates, "mean": m.mean.tolist(), "deviation": m.deviation.tolist(), "axes": m.axes.tolist(), "limit": m.limit}
        )

    @classmethod
    def from_json(cls, text: str) -> FittedDetector:
        d = json.loads(text)
        p = len(d["templates"])
        model = PcaModel(np.array(d["mean"]), np.array(d["deviation"]), np.array(d["axes"]).reshape(p, -1), d["limit"])
        return cls(d["templates"], model)

    def score(self, counts: DataFrame) -> DataFrame:
        """(Window, AnomalyScore, IsAnomaly) of the windows in counts(Window, EventTemplate, cnt)."""
        known = counts.sparkSession.createDataFrame(list(enumerate(self.templates)), "feature_id int, EventTemplate string")
        placed = counts.join(F.broadcast(known), "EventTemplate", "left")
        pairs = F.filter(F.collect_list(F.struct("feature_id", F.col("cnt").cast("double").alias("value"))), lambda x: x["feature_id"].isNotNull())
        vectors = placed.groupBy("Window").agg(F.array_sort(pairs).alias("_v"))
        vectors = vectors.select("Window", F.col("_v.feature_id").alias("ids"), F.col("_v.value").alias("values"))
        return _scored(vectors, self.model, len(self.templates), dict(counts.dtypes)["Window"])


def fit_detector(counts: DataFrame, config: AnomalyConfig) -> FittedDetector | None:
    """Fit on all windows of counts; None where there are fewer than two."""
    dictionary, p = _dictionary(counts)
    if p > MOST_FEATURES:
        raise ValueError(f"a kept detector has at most {MOST_FEATURES} templates")
    features = counts.select("Window", F.col("EventTemplate").alias("feature"), F.col("cnt").cast("double").alias("value"))
    model = fit_pca(_vectors(features, dictionary), p, config)
    return FittedDetector([r.feature for r in dictionary.orderBy("feature_id").collect()], model) if model else None


Detector = Callable[[DataFrame, AnomalyConfig], DataFrame]

#: Detectors by the name that a config's algorithm gives; register() adds to them.
DETECTORS: dict[str, Detector] = {"pca_subspace": score_windows}


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


def detect(counts: DataFrame, config: AnomalyConfig) -> DataFrame:
    if config.algorithm not in DETECTORS:
        raise ValueError(f"Unknown algorithm {config.algorithm!r}; one of {sorted(DETECTORS)}")
    return DETECTORS[config.algorithm](counts, config)
