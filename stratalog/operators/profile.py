"""Data quality and run metrics."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_profile(rows: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows, and a map of null counts by column.

    Rows are counted by the hash-free distinct of all columns, which is combined before its
    shuffle; the null counts ride along as sums.
    """
    names = rows.columns
    grouped = rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count("*").alias("_n"))
    nulls = [F.sum(F.when(F.col(f"`{c}`").isNull(), F.col("_n")).otherwise(0)).alias(f"_null_{i}") for i, c in enumerate(names)]
    found = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("_distinct"), *nulls)
    entries = [x for i, c in enumerate(names) for x in (F.lit(c), F.coalesce(F.col(f"_null_{i}"), F.lit(0)))]
    return found.select(
        "n_rows", F.lit(len(names)).cast("long").alias("n_columns"), (F.col("n_rows") - F.col("_distinct")).alias("n_duplicates"),
        F.create_map(*entries).alias("null_counts"), (F.col("n_rows") == 0).alias("empty_dataset"),
    )


class RunMetrics:
    """Stage times and named values of a run."""

    def __init__(self) -> None:
        self.timings: dict[str, float] = {}
        self.values: dict[str, Any] = {}

    @contextmanager
    def timer(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings[name] = time.perf_counter() - began

    def add(self, name: str, value: Any) -> None:
        self.values[name] = value

    def summary(self) -> dict[str, Any]:
        return {"timings": dict(self.timings), "metrics": dict(self.values), "total_time": sum(self.timings.values())}
