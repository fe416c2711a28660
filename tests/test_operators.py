from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalog.config import AnomalyConfig, ParsingConfig, PipelineConfig, PreprocessingConfig, WindowingConfig
from stratalog.operators import evaluate, matrix, profile, records, scoring, templates
from stratalog.operators.preprocess import parse_lines
from stratalog.operators.windows import assign_windows
from stratalog.plans.pipeline import compare_strategies
from stratalog.sources.readers import from_lines

# The form of an Apache log's lines and times.
APACHE = PreprocessingConfig(r"\[(?P<Timestamp>.+?)\]\s+\[(?P<LogLevel>\w+)]\s+(?P<Content>.+)", "%a %b %d %H:%M:%S %Y")
LINES = [
    "[Sun Dec 04 04:47:44 2005] [notice] child 17 is up, config /srv/web/site.conf",
    "[Sun Dec 04 04:47:44 2005] [error] child 18 failed with state 6",
    "  ",
    "not a line",
    "[Sun Dec 99 04:47:44 2005] [error] bad time",
]
CLOCK = datetime(2024, 1, 1)


def test_lenient_and_strict(spark):
    lines = from_lines(spark, LINES)
    lenient = parse_lines(lines, APACHE, CLOCK).orderBy("LineNumber").collect()
    assert [(r.LineNumber, r.LogLevel) for r in lenient] == [("1", "notice"), ("2", "error"), ("4", "UNKNOWN")]
    assert lenient[2].Content == "not a line" and lenient[2].Timestamp == CLOCK
    strict = parse_lines(lines, PreprocessingConfig(APACHE.log_pattern, APACHE.timestamp_format, strict_mode=True))
    assert strict.count() == 2
    kept = parse_lines(lines, PreprocessingConfig(APACHE.log_pattern, APACHE.timestamp_format, True, False))
    assert kept.where("Timestamp IS NULL").count() == 1
    with pytest.raises(ValueError, match="raw_log"):
        parse_lines(spark.range(1), APACHE)
    assert parse_lines(from_lines(spark, []), APACHE).columns[:3] == ["Timestamp", "LogLevel", "Content"]


MASKS = ParsingConfig(masking_rules=templates.DEFAULT_MASKS)


def test_masks_are_idempotent(spark):
    rows = spark.createDataFrame([("from 10.0.0.1 port 22 id 0xff $1 \\",), ("-5 and +7",)], "Content string")
    once = rows.select(templates.masked(F.col("Content"), MASKS).alias("Content"))
    assert [r.Content for r in once.collect()] == ["from <:IP:> port <:NUM:> id <:HEX:> $<:NUM:> \\", "<:NUM:> and <:NUM:>"]
    assert once.select(templates.masked(F.col("Content"), MASKS).alias("c")).collect()[0].c == once.collect()[0].Content


def _messages(spark):
    data = [(f"s{i % 2}", i, f"open file f{i}" if i % 3 else f"close port {i} now") for i in range(60)]
    return spark.createDataFrame(data, "datastream string, line_no long, Content string")


def test_mined_templates(spark):
    rows = templates.mined_templates(_messages(spark), MASKS, "datastream").collect()
    assert len(rows) == 60
    for s in ("s0", "s1"):
        ids = sorted({r.TemplateId for r in rows if r.datastream == s})
        assert ids == list(range(1, len(ids) + 1)) and len(ids) == 2
    for r in rows:
        words = r.EventTemplate.split(" ")
        raw = r.Content.split(" ")
        assert all(w == t or w == templates.WILDCARD or w.startswith("<:") for w, t in zip(words, raw))
        assert len(words) == len(raw)
    again = templates.distinct_templates(_messages(spark), MASKS, "datastream").collect()
    assert {(r.line_no, r.TemplateId) for r in again} == {(r.line_no, r.TemplateId) for r in rows}


def test_tree_forgets_the_oldest():
    tree = templates.TemplateTree(ParsingConfig(max_clusters=2, extra_delimiters=[]))
    assert [tree.add(w.split())[0] for w in ("a b", "c d", "e f", "c d", "a b")] == [1, 2, 3, 2, 4]
    assert len(tree.templates) == 2


def test_masked_ids_are_dense(spark):
    rows = templates.masked_templates(_messages(spark), MASKS)
    assert sorted({r.TemplateId for r in rows.select("TemplateId").collect()})[0] == 1
    with pytest.raises(ValueError, match="Content"):
        templates.masked_templates(spark.range(1), MASKS)


def test_matrix(spark):
    w = spark.createDataFrame([(1, ["A", "A", "B"]), (2, ["B", "C"])], "Window long, EventTemplates array<string>")
    counts = matrix.counts_of_windows(w)
    wide = matrix.wide_matrix(counts).orderBy("Window").collect()
    assert [tuple(r) for r in wide] == [(1, 2, 1, 0), (2, 0, 1, 1)]
    assert matrix.count_maps(counts).where("Window = 1").first().counts == {"A": 2, "B": 1}
    with pytest.raises(ValueError):
        matrix.wide_matrix(spark.createDataFrame([(1, "Window", 1)], "Window long, EventTemplate string, cnt long"))


def direct_scores(x, share, alpha, scale=True):
    z = x - x.mean(0)
    if scale:
        z = z / np.where(x.std(0) > 1e-12, x.std(0), 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    values = s**2 / (len(x) - 1)
    k = min(max(int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1), 1), len(values))
    residual = z @ (np.eye(x.shape[1]) - vt[:k].T @ vt[:k])
    return (residual**2).sum(1), scoring.residual_limit(values, k, alpha)


@pytest.mark.parametrize("scale", [True, False])
def test_scores_against_numpy(spark, scale):
    rng = np.random.default_rng(42)
    x = rng.poisson(5, (50, 10))
    x[45:48] = rng.poisson(20, (3, 10))
    data = [(i, f"event_{j}", int(x[i, j])) for i in range(50) for j in range(10) if x[i, j]]
    counts = spark.createDataFrame(data, "Window long, EventTemplate string, cnt long")
    config = AnomalyConfig(variance_threshold=0.8, use_scaling=scale)
    got = scoring.detect(counts, config).orderBy("Window").collect()
    expected, limit = direct_scores(x.astype(float), 0.8, config.alpha, scale)
    assert np.allclose([r.AnomalyScore for r in got], expected, atol=1e-8)
    assert [r.IsAnomaly for r in got] == (expected > limit).tolist()


def test_degenerate_scores(spark):
    one = spark.createDataFrame([(0, "a", 3)], "Window long, EventTemplate string, cnt long")
    r = scoring.detect(one, AnomalyConfig()).first()
    assert (r.AnomalyScore, r.IsAnomaly) == (0.0, False)
    assert scoring.detect(one.limit(0), AnomalyConfig()).count() == 0
    same = spark.createDataFrame([(i, "a", 3) for i in range(4)], "Window long, EventTemplate string, cnt long")
    assert not any(r.IsAnomaly for r in scoring.detect(same, AnomalyConfig(use_tfidf=True)).collect())
    with pytest.raises(ValueError, match="Unknown algorithm"):
        scoring.detect(one, AnomalyConfig(algorithm="guess"))


def test_registered_detector(spark):
    scoring.register("zero", lambda counts, config: counts.select("Window").distinct())
    one = spark.createDataFrame([(0, "a", 3)], "Window long, EventTemplate string, cnt long")
    assert scoring.detect(one, AnomalyConfig(algorithm="zero")).count() == 1


def test_undefined_measures_are_zero(spark):
    rows = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    assert tuple(evaluate.precision_recall_f1(rows, "t", "p").first()) == (0.0, 0.0, 0.0, 0.0)


def test_list_and_label_text(spark):
    rows = spark.createDataFrame([(["A", "B"], 'a\\b\n "c"  ')], "l array<string>, t string")
    r = rows.select(records.list_text(F.col("l")).alias("l"), records.label_value(F.col("t")).alias("t")).first()
    assert (r.l, r.t) == ("['A','B']", "a b 'c'")
    empty = spark.createDataFrame([([],), (None,)], "l array<string>").select(records.list_text(F.col("l")).alias("l"))
    assert [x.l for x in empty.collect()] == ["[]", "[]"]


def test_profile(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    r = profile.quality_profile(rows).first()
    assert (r.n_rows, r.n_columns, r.n_duplicates, r.null_counts, r.empty_dataset) == (3, 2, 1, {"a": 0, "b": 2}, False)
    assert profile.quality_profile(rows.limit(0)).first().empty_dataset
    m = profile.RunMetrics()
    with m.timer("x"):
        m.add("n", 1)
    assert m.summary()["metrics"] == {"n": 1} and m.summary()["total_time"] >= 0


def test_fitted_detector_scores_later_windows(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(5, (40, 6))
    data = [(i, f"e{j}", int(x[i, j])) for i in range(40) for j in range(6) if x[i, j]]
    counts = spark.createDataFrame(data, "Window long, EventTemplate string, cnt long")
    config = AnomalyConfig(variance_threshold=0.7)
    fitted = scoring.FittedDetector.from_json(scoring.fit_detector(counts, config).to_json())
    want = {r.Window: r.AnomalyScore for r in scoring.detect(counts, config).collect()}
    got = {r.Window: r.AnomalyScore for r in fitted.score(counts).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    new = spark.createDataFrame([(99, "unknown", 3), (98, "e0", 400)], counts.schema)
    flags = {r.Window: r.IsAnomaly for r in fitted.score(new).collect()}
    assert flags[98] and set(flags) == {98, 99}
    assert scoring.fit_detector(counts.where("Window = 0"), config) is None


@pytest.mark.parametrize("share", [0.95, 0.6])
def test_strategies_against_numpy(spark, share):
    """Windows and flagged share of each strategy, from a count table of its own windows."""
    rng = np.random.default_rng(3)
    start = datetime(2024, 1, 1)
    kinds = rng.choice(list("abcde"), 600, p=[0.4, 0.3, 0.15, 0.1, 0.05])
    kinds[500:520] = "e"
    seconds = np.cumsum(rng.integers(20, 700, 600))
    rows = spark.createDataFrame(
        [(start + timedelta(seconds=int(s)), str(k), i) for i, (s, k) in enumerate(zip(seconds, kinds))],
        "Timestamp timestamp, EventTemplate string, line_no long",
    )
    settings = {
        "fixed": {"window_size": "1h"},
        "sliding": {"strategy": "sliding", "window_size": "2h", "step_size": "1h"},
        "session": {"strategy": "session", "session_timeout": "10m"},
        "adaptive": {"strategy": "adaptive", "min_window_size": "10m", "max_window_size": "2h", "target_logs_per_window": 20},
    }
    configs = {
        name: PipelineConfig(None, APACHE, windowing=WindowingConfig(**w), anomaly_detection=AnomalyConfig(variance_threshold=share))
        for name, w in settings.items()
    }
    got = {r.strategy: (r.windows, r.anomaly_rate) for r in compare_strategies(rows, configs).collect()}
    assert set(got) == set(settings)
    rates = []
    for name, c in configs.items():
        table = assign_windows(rows, c.windowing).select("Window", "EventTemplate").toPandas()
        x = pd.crosstab(table["Window"], table["EventTemplate"]).to_numpy(float)
        scores, limit = direct_scores(x, share, c.anomaly_detection.alpha)
        rates.append(float((scores > limit).mean()))
        assert got[name] == (len(x), pytest.approx(rates[-1])), name
    assert share > 0.9 or any(rates)
