"""Stages as objects: what a user subclasses to put a step of their own into a run."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalog.config import AnomalyConfig, ParsingConfig, PreprocessingConfig, WindowingConfig
from stratalog.functions.patterns import to_java
from stratalog.operators.matrix import counts_of_windows
from stratalog.operators.preprocess import parse_lines, parsed_columns
from stratalog.operators.scoring import DETECTORS, detect
from stratalog.operators.templates import extract_templates
from stratalog.operators.windows import assign_windows, check_strategy, window_table


class Stage(ABC):
    """A step from DataFrame to DataFrame with a config that is checked when it is made."""

    def __init__(self, config: Any):
        self.config = config
        self.validate()

    def validate(self) -> None:
        """Raise ValueError for a config that cannot work."""

    @abstractmethod
    def transform(self, rows: DataFrame) -> DataFrame: ...


class Preprocess(Stage):
    config: PreprocessingConfig

    def validate(self) -> None:
        parsed_columns(self.config)
        to_java(self.config.log_pattern)

    def transform(self, rows: DataFrame) -> DataFrame:
        if "line_no" not in rows.columns:
            rows = rows.withColumn("line_no", F.monotonically_increasing_id() + 1)
        return parse_lines(rows, self.config)


class Templates(Stage):
    config: ParsingConfig

    def validate(self) -> None:
        for rule in self.config.masking_rules:
            to_java(rule["regex_pattern"])

    def transform(self, rows: DataFrame) -> DataFrame:
        return extract_templates(rows, self.config)


class Windowing(Stage):
    config: WindowingConfig

    def validate(self) -> None:
        check_strategy(self.config.strategy)

    def transform(self, rows: DataFrame) -> DataFrame:
        return window_table(assign_windows(rows, self.config))


class EventMatrix(Stage):
    def transform(self, rows: DataFrame) -> DataFrame:
        return counts_of_windows(rows)


class Detector(Stage):
    config: AnomalyConfig

    def validate(self) -> None:
        if self.config.algorithm not in DETECTORS:
            raise ValueError(f"Unknown algorithm {self.config.algorithm!r}")

    def transform(self, rows: DataFrame) -> DataFrame:
        return detect(rows, self.config)


def chained(rows: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    """rows through every stage, as one lazy plan."""
    for stage in stages:
        rows = rows.transform(stage.transform)
    return rows


def aligned(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows with just the columns of schema, in its order and types; null for absent ones."""
    have = set(rows.columns)
    return rows.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def relaxed_union(parts: Iterable[DataFrame]) -> DataFrame:
    """Parts under each other by column name; a column that a part lacks is null there."""
    parts = list(parts)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
