"""Where rows come from: text, CSV, Parquet and JSON files, memory, and stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.config import DatasetConfig
from stratalog.functions.patterns import strip
from stratalog.operators.preprocess import with_line_numbers
from stratalog.sources.arrays import read_json_array


def _decoded(value: Column) -> Column:
    """UTF-8 bytes as text without those that are not UTF-8, and without carriage returns at the
    end. A replacement character that was written stays: it is put aside meanwhile."""
    aside = F.lit("\uFDD0")
    broken = F.replace(F.make_valid_utf8(F.replace(value, F.lit("\uFFFD"), aside)), F.lit("\uFFFD"), F.lit(""))
    text = F.when(F.is_valid_utf8(value), value).otherwise(F.replace(broken, aside, F.lit("\uFFFD")))
    return F.regexp_replace(text, "\\r+$", "")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(raw_log, line_no) of UTF-8 lines that are not blank; bytes that are not UTF-8 are left
    out, line numbers count from 1 over what is left."""
    lines = with_line_numbers(spark.read.text(path).where(F.length(strip(F.col("value"))) > 0))
    return lines.select(_decoded(F.col("value")).alias("raw_log"), "line_no")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file or a folder of parts, whose columns may differ."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or documents that are arrays of rows, both read split by split: the first
    character of a file that is not blank tells."""
    heads = spark.read.option("lineSep", "{").text(path).where("_metadata.file_block_start = 0")
    text = F.ltrim(F.translate("value", "\ufeff\t\r\n", "    "))
    first = heads.where(F.length(text) > 0).select(F.left(text, F.lit(1))).limit(1).first()
    return read_json_array(spark, path) if first and first[0] == "[" else spark.read.json(path)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "raw": read_text, "csv": read_csv, "parquet": read_parquet, "json": read_json,
}


def detect_format(path: str, fmt: str | None) -> str:
    """raw if asked for; else the first of csv, parquet, json that the format or the suffix
    names; else raw."""
    if fmt == "raw":
        return "raw"
    suffix = PurePosixPath(path).suffix.lstrip(".").lower()
    return next((k for k in ("csv", "parquet", "json") if k in (fmt, suffix)), "raw")


def load_dataset(spark: SparkSession, config: DatasetConfig) -> DataFrame:
    """The rows of a configured file."""
    if config.type != "file":
        raise ValueError(f"Unsupported dataset type: {config.type}")
    if not config.path:
        raise ValueError("dataset.path is missing")
    try:
        return READERS[detect_format(config.path, config.format)](spark, config.path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(config.path) from e
        raise


def from_lines(spark: SparkSession, lines: Sequence[str], start: int = 1) -> DataFrame:
    """(raw_log, line_no) of lines in memory."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(lines, start)], "raw_log string, line_no long")


def stream_text(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of files that appear in a folder, as a stream of raw_log."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).where(F.length("value") > 0)
    return lines.select(_decoded(F.col("value")).alias("raw_log"))


def stream_json_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Ingest requests (message, datastream, timestamp) from a socket of JSON lines."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    parsed = F.from_json("value", "message string, datastream string, timestamp string, original_timestamp string")
    return lines.select(parsed.alias("r")).select("r.*")


def read_results(spark: SparkSession, folder: str, stage: str = "anomalies") -> DataFrame:
    """A stored stage, from its folder of parts or its single file: Parquet, then CSV, then JSON."""
    for kind in ("parquet", "csv", "json"):
        for path in (f"{folder}/{stage}.{kind}", f"{folder}/{kind}/{stage}", f"{folder}/{stage}"):
            try:
                if kind == "parquet":
                    return read_parquet(spark, path)
                return read_csv(spark, path) if kind == "csv" else spark.read.json(path)
            except AnalysisException:
                continue
    raise FileNotFoundError(f"no {stage} below {folder}")
