"""A whole run: lines, templates, windows, counts, scores, and a summary."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime
from threading import Thread

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratalog.config import PipelineConfig
from stratalog.operators import forest  # noqa: F401  its detector is registered
from stratalog.operators.matrix import counts_of_windows, event_counts, window_metadata
from stratalog.operators.preprocess import parse_lines
from stratalog.operators.scoring import detect
from stratalog.operators.templates import extract_templates
from stratalog.operators.windows import assign_windows, check_strategy, window_table
from stratalog.sources.readers import load_dataset
from stratalog.sources.writers import run_folder, save_stages

_log = logging.getLogger("stratalog")

STAGES = ("preprocessed", "templates", "windowed", "event_matrix", "anomalies")


def _matrix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The long matrix with its windows' metadata."""
    return counts.join(window_metadata(windows), "Window", "left")


def scored(windows: DataFrame, counts: DataFrame, config: PipelineConfig) -> DataFrame:
    """Scores beside each window's metadata; windows without templates score 0."""
    found = window_metadata(windows).join(detect(counts, config.anomaly_detection), "Window", "left")
    return found.withColumns(
        {"AnomalyScore": F.coalesce("AnomalyScore", F.lit(0.0)), "IsAnomaly": F.coalesce("IsAnomaly", F.lit(False))}
    )


def summarise(stages: dict[str, DataFrame]) -> DataFrame:
    """One row of a run's five numbers; 0 where a stage is empty."""
    logs = stages["templates"].agg(F.count("*").alias("total_logs"), F.count_distinct("TemplateId").alias("unique_templates"))
    windows = stages["anomalies"].agg(
        F.count("*").alias("total_windows"), F.coalesce(F.sum(F.col("IsAnomaly").cast("long")), F.lit(0)).alias("anomalous_windows"),
        F.coalesce(F.avg(F.col("IsAnomaly").cast("double")), F.lit(0.0)).alias("anomaly_rate"),
    )
    return logs.crossJoin(windows)


@dataclass
class BatchPipeline:
    """The stages of one config. They are lazy; templated rows, which three stages read, are
    kept, spilling to disk where memory is short."""

    spark: SparkSession
    config: PipelineConfig
    clock: datetime | None = None
    stream: str | None = None

    def __post_init__(self) -> None:
        check_strategy(self.config.windowing.strategy)
        self.clock = self.clock or datetime.now()
        self.seen: Observation | None = None

    def unmatched(self, seconds: float = 10) -> tuple[int, int] | None:
        """(lines that are not blank, those that the pattern does not match) as the rows were computed;
        None if they were not, as where Spark sees that there are none."""
        found: list[dict] = []

        def look() -> None:
            try:
                found.append(self.seen.get)
            except (Py4JJavaError, PySparkException) as e:  # the plan ended without the rows
                _log.debug("no counts of lines: %s", e)

        waiting = Thread(target=look, daemon=True)
        waiting.start()
        waiting.join(seconds)
        return (found[0]["lines"], found[0]["unmatched"]) if found else None

    def stages(self, lines: DataFrame | None = None) -> dict[str, DataFrame]:
        lines = load_dataset(self.spark, self.config.dataset) if lines is None else lines
        if "line_no" not in lines.columns:
            lines = lines.withColumn("line_no", F.monotonically_increasing_id() + 1)
        self.seen = Observation()
        rows = parse_lines(lines, self.config.preprocessing, self.clock, self.seen)
        templates = extract_templates(rows, self.config.parsing, self.stream).persist(StorageLevel.MEMORY_AND_DISK)
        assigned = assign_windows(templates, self.config.windowing)
        windows, counts = window_table(assigned), event_counts(assigned)
        found = (rows, templates, windows, _matrix(windows, counts), scored(windows, counts, self.config))
        return dict(zip(STAGES, found))

    def run(self, lines: DataFrame | None = None, save: bool = True) -> tuple[dict[str, DataFrame], dict]:
        """(stages, summary); stages are saved where the config asks for it."""
        stages = self.stages(lines)
        summary = summarise(stages).first().asDict() | {"run_timestamp": self.clock.isoformat()}
        total, unmatched = self.unmatched() or (0, 0)
        if unmatched:
            what = "left out" if self.config.preprocessing.strict_mode else "kept as they are"
            _log.warning("%d of %d lines do not match log_pattern and are %s", unmatched, total, what)
        if save and self.config.output.save_intermediate:
            save_stages(stages, run_folder(self.config.output.directory, self.clock), self.config.output.formats)
        return stages, summary


def compare_strategies(rows: DataFrame, configs: dict[str, PipelineConfig]) -> DataFrame:
    """(strategy, windows, anomaly_rate) of the same templated rows under several configs."""
    parts = []
    for name, config in configs.items():
        assigned = assign_windows(rows, config.windowing)
        found = scored(window_table(assigned), event_counts(assigned), config)
        parts.append(
            found.agg(F.count("*").alias("windows"), F.coalesce(F.avg(F.col("IsAnomaly").cast("double")), F.lit(0.0)).alias("anomaly_rate"))
            .withColumn("strategy", F.lit(name))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("strategy", "windows", "anomaly_rate")


__all__ = ["STAGES", "BatchPipeline", "compare_strategies", "counts_of_windows", "scored", "summarise"]
