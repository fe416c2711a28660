"""Template counts per window: in long form, as a map, or as a wide matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.scans import numbered

METADATA = ("WindowStart", "WindowEnd", "LogCount")
#: Columns that a wide matrix may have; beyond it, keep the long form.
MOST_COLUMNS = 10_000


def event_counts(assigned: DataFrame, keys: tuple[str, ...] = ("Window",)) -> DataFrame:
    """(*keys, EventTemplate, cnt) straight from assigned rows: no lists are built on the way."""
    return assigned.groupBy(*keys, "EventTemplate").agg(F.count("*").alias("cnt"))


def counts_of_windows(windows: DataFrame) -> DataFrame:
    """The long form of a window table's lists."""
    return windows.select("Window", F.explode("EventTemplates").alias("EventTemplate")).groupBy("Window", "EventTemplate").agg(
        F.count("*").alias("cnt")
    )


def window_metadata(windows: DataFrame) -> DataFrame:
    """One row per Window value with its bounds and count; where several windows share a
    value, those of the first."""
    order = F.struct("WindowStart", "WindowEnd", "LogCount")
    return windows.groupBy("Window").agg(*[F.min_by(c, order).alias(c) for c in METADATA])


def feature_dictionary(counts: DataFrame) -> DataFrame:
    """(EventTemplate, feature_id) by first appearance, then name; one row per template."""
    return numbered(_first(counts), ["_first", "EventTemplate"], "feature_id").select("EventTemplate", F.col("feature_id").cast("int"))


def _first(counts: DataFrame) -> DataFrame:
    return counts.groupBy("EventTemplate").agg(F.min("Window").alias("_first"))


def wide_matrix(counts: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Window and one count column per template, in order of first appearance, 0 where none."""
    names = [r[0] for r in _first(counts).select("EventTemplate", "_first").orderBy("_first", "EventTemplate").limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} templates: use the long form")
    if clash := {"Window", *METADATA} & set(names):
        raise ValueError(f"templates named like columns: {sorted(clash)}")
    wide = counts.groupBy("Window").pivot("EventTemplate", names).agg(F.sum("cnt")).na.fill(0)
    return wide if metadata is None else wide.join(metadata, "Window", "left")


def count_maps(counts: DataFrame) -> DataFrame:
    """(Window, counts MAP<STRING, BIGINT>): one fixed schema for any templates."""
    pairs = F.array_sort(F.collect_list(F.struct("EventTemplate", "cnt")))
    return counts.groupBy("Window").agg(F.map_from_entries(pairs).alias("counts"))
