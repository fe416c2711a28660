"""Raw lines to typed columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stratalog.config import PreprocessingConfig
from stratalog.functions.patterns import group_names, match_groups, named_groups, strip
from stratalog.functions.times import parse_time


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """lines with line_no, from 1, in the order of files and of lines in them.

    Two narrow passes: the rows of each file split are counted, and the few counts are
    summed up and broadcast (one row a split). Rows that come from no file are numbered in
    the order of their partitions.
    """
    keys = ["_file", "_start", "_part"]
    rows = lines.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    if lines.isStreaming:
        raise ValueError("a stream has no line numbers")
    try:
        placed = lines.select("*", "_metadata.file_path", "_metadata.file_block_start")
        placed = placed.withColumnsRenamed({"file_path": "_file", "file_block_start": "_start"})
        rows = placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    except Exception as e:  # no file behind the rows: there is no metadata column
        if "_metadata" not in str(e):
            raise
        rows = rows.withColumns({"_file": F.lit(""), "_start": F.lit(0).cast("long")})
    splits = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    order = Window.orderBy("_file", "_start", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return (
        rows.join(F.broadcast(before), keys)
        .withColumn("line_no", F.col("_before") + F.col("_id") - F.col("_first") + 1)
        .select(*lines.columns, "line_no")
    )


def parsed_columns(config: PreprocessingConfig) -> list[str]:
    """The columns that lines get: the pattern's groups, and what lenient mode adds."""
    names = group_names(config.log_pattern)
    if not names:
        raise ValueError("log_pattern has no named groups")
    added = [] if config.strict_mode else [n for n in ("Content", "Timestamp", "LogLevel") if n not in names]
    return names + added


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row: filters that use it are not pushed below
    it, where they would hold copies of its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def parse_lines(lines: DataFrame, config: PreprocessingConfig, clock: datetime | None = None, seen: Observation | None = None) -> DataFrame:
    """Typed rows of lines(raw_log, line_no).

    A line that the pattern does not match is dropped in strict mode; otherwise it is kept
    with itself as Content, level UNKNOWN and the run's clock as its time. A time that does
    not parse is null, and such rows are dropped where times are required. No shuffle: all is
    one projection and a filter. seen, if given, gets the numbers of lines that are not blank and
    of unmatched ones when the rows are computed, without a pass of its own.
    """
    if "raw_log" not in lines.columns:
        raise ValueError("Input DataFrame must have 'raw_log' column")
    text = strip(F.col("raw_log"))
    rows = once(lines, "_text", text).where(F.length("_text") > 0)
    rows = once(rows, "_groups", match_groups(F.col("_text"), config.log_pattern))
    hit, groups, names = F.size("_groups") > 1, named_groups(F.col("_groups"), config.log_pattern), parsed_columns(config)
    if seen:
        rows = rows.observe(seen, F.count("*").alias("lines"), F.count_if(~hit).alias("unmatched"))
    now = F.lit(clock).cast("timestamp_ntz") if clock else F.localtimestamp()
    if config.strict_mode:
        rows, instead = rows.where(hit), {}
    else:
        instead = {"Content": F.col("_text"), "LogLevel": F.lit("UNKNOWN")}
    null = F.lit(None).cast("string")
    columns = {}
    for name in names:
        value = groups.get(name, null)
        if name == "Timestamp":
            value = parse_time(value, config.timestamp_format)
            value = value if config.strict_mode else F.when(hit, value).otherwise(now)
        elif not config.strict_mode:
            value = F.when(hit, value).otherwise(instead.get(name, null))
        columns[name] = value
    keep = [c for c in lines.columns if c not in {"raw_log", *names}]
    out = rows.select(*[c.alias(n) for n, c in columns.items()], F.col("line_no").cast("string").alias("LineNumber"), *keep)
    if config.require_timestamps and "Timestamp" in names:
        out = out.where("Timestamp IS NOT NULL")
    return out
