"""Where stages go: Parquet, JSON lines and CSV, as whole runs or batch by batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from stratalog.operators.records import flat_for_csv

FORMATS = ("parquet", "csv", "json")
#: Text forms of times with all their microseconds; Spark's own stop at thousandths.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new, not yet existing folder below spark.checkpoint.dir, which the driver and all
    executors see; only where all runs in one process may that setting be missing."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratalog-')}"
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def run_folder(directory: str, now: datetime | None = None) -> str:
    """The folder of one run, named by its time."""
    return f"{directory.rstrip('/')}/{(now or datetime.now()):%Y%m%d-%H%M%S}"


def write_stage(rows: DataFrame, folder: str, stage: str, fmt: str, mode: str = "errorifexists", part: str = "") -> str | None:
    """Write one stage, or the named part of it, as a folder of part files; other formats than
    FORMATS are left out."""
    path = f"{folder}/{stage}.{fmt}" + (f"/{part}" if part else "")
    if fmt == "parquet":
        rows.write.mode(mode).option("compression", "zstd").parquet(path)
    elif fmt == "json":
        rows.write.mode(mode).options(**TIMES).json(path)
    elif fmt == "csv":
        flat_for_csv(rows).write.mode(mode).options(header=True, **TIMES).csv(path)
    else:
        return None
    return path


def save_stages(stages: dict[str, DataFrame], folder: str, formats: list[str]) -> list[str]:
    """Write every stage that has rows in every format."""
    paths = []
    for stage, rows in stages.items():
        if rows.columns and not rows.isEmpty():
            paths += [p for f in formats if (p := write_stage(rows, folder, stage, f))]
    return paths


def append_stage(rows: DataFrame, folder: str, stage: str, formats: list[str]) -> None:
    """Add the rows of one batch to a stage's folders; an empty batch adds nothing."""
    if rows.columns and not rows.isEmpty():
        for f in formats:
            write_stage(rows, folder, stage, f, mode="append")
