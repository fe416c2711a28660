"""Windows over event times: fixed, sliding, session, and adaptive by volume.

Each strategy assigns rows to windows; window_table then makes one row per window. The
settings of a config that are null take the defaults below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.config import WindowingConfig
from stratalog.functions.durations import parse_duration, positive_duration
from stratalog.operators.scans import numbered, scan
from stratalog.operators.volume import volume_windows

STRATEGIES = ("fixed", "sliding", "session", "adaptive")
STEP, SESSION_TIMEOUT, TARGET, LEAST, MOST = "1m", "30m", 100, "1m", "1h"
#: Seconds of the time slices in which sessions are found side by side.
SLICE = 3600


def check_strategy(name: str) -> None:
    if name not in STRATEGIES:
        raise ValueError(f"Invalid windowing strategy: {name!r}; must be one of {', '.join(STRATEGIES)}")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def _plus(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def _timed(rows: DataFrame) -> DataFrame:
    if "Timestamp" not in rows.columns:
        raise ValueError("Data must have 'Timestamp' column")
    return rows.where("Timestamp IS NOT NULL")


def fixed_windows(rows: DataFrame, size: str) -> DataFrame:
    """rows with Window, the start of the bucket of the given size that holds Timestamp."""
    seconds = positive_duration(size, "window_size")
    return _timed(rows).withColumn("Window", F.window("Timestamp", f"{seconds} seconds").start)


def sliding_windows(rows: DataFrame, size: str, step: str | None = None) -> DataFrame:
    """rows, once for each window [start, start + size) that holds them; starts are the first
    event's time and every step after. A row's windows are computed from its own time, so
    the cost is rows times size / step; only the least time is looked up."""
    width = positive_duration(size, "window_size") * 1_000_000
    stride = positive_duration(step or STEP, "step_size") * 1_000_000
    rows = _timed(rows)
    first = rows.agg(F.min("Timestamp").alias("_first"))
    off = micros_between(F.col("_first"), F.col("Timestamp"))
    # in whole numbers: a division of doubles may round a bound up
    low, high = F.expr(f"if(_off >= {width}, (_off - {width}) div {stride} + 1, 0)"), F.expr(f"_off div {stride}")
    placed = rows.crossJoin(F.broadcast(first)).withColumn("_off", off).withColumns({"_low": low, "_high": high})
    each = placed.where("_low <= _high").withColumn("_k", F.explode(F.sequence("_low", "_high")))
    start = _plus(F.col("_first"), F.col("_k") * stride)
    return (
        each.withColumn("Window", start)
        .withColumns({"_start": F.col("Window"), "_end": _plus(F.col("Window"), F.lit(width))})
        .drop("_first", "_off", "_low", "_high", "_k")
    )


def session_windows(rows: DataFrame, timeout: str | None = None, key: str | None = None) -> DataFrame:
    """rows with SessionId, from 1, by key or over all: a new one after a gap of more than
    timeout in whole seconds.

    Time is cut into slices. Sessions are found in each slice; what crosses slices is one row
    a slice (its last time and its number of breaks), over which a scan goes, so no task holds
    all rows or slices even without a key.
    """
    seconds = parse_duration(timeout or SESSION_TIMEOUT)
    keys = [key] if key else []
    order = [c for c in ("Timestamp", "line_no", "EventTemplate") if c in rows.columns]
    rows = _timed(rows).withColumn("_slice", F.window("Timestamp", f"{SLICE} seconds").start)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = rows.withColumns({"_before": F.lag("Timestamp").over(inside), "_nth": F.row_number().over(inside)})
    gap = F.timestamp_diff("SECOND", F.col("_before"), F.col("Timestamp")) > seconds
    ranked = ranked.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("long"))
    slices = ranked.groupBy(*keys, "_slice").agg(
        F.min("Timestamp").alias("_least"), F.max("Timestamp").alias("_last"), F.sum("_new").alias("_breaks")
    )
    if keys:  # a key has a row for each slice with rows
        over = Window.partitionBy(*keys).orderBy("_slice")
        slices = slices.withColumn("_ended", F.lag("_last").over(over))
    else:
        slices = scan(slices, ["_slice"], previous={"_ended": "_last"})
    since = F.timestamp_diff("SECOND", F.col("_ended"), F.col("_least"))
    slices = slices.withColumn("_opens", F.coalesce(since > seconds, F.lit(True)).cast("long"))
    starts = F.col("_opens") + F.col("_breaks")
    if keys:
        slices = slices.withColumn("_total", F.sum(starts).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        slices = scan(slices, ["_slice"], {"_total": starts})
    slices = slices.select(*keys, "_slice", (F.col("_total") - F.col("_breaks")).alias("_base"))
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = ranked.withColumn("_in", running).join(slices, [*keys, "_slice"])
    out = joined.withColumn("SessionId", F.col("_base") + F.col("_in"))
    return out.drop("_slice", "_before", "_nth", "_new", "_base", "_in")


def adaptive_windows(
    rows: DataFrame, target: int | None = None, least: str | None = None, most: str | None = None, key: str | None = None
) -> DataFrame:
    """rows, once for each volume window that holds them, by key or over all; rows without key are
    in none.

    A window takes target rows. If they span less than least and rows remain, it takes all up
    to start + least; else if they span more than most, only those up to start + most. Both
    go by time, so rows tied with the start count even where an earlier window had them, and
    the next window starts after as many rows as this one has. Rows and windows meet by position.
    """
    target = target or TARGET
    low, high = parse_duration(least or LEAST) * 1_000_000, parse_duration(most or MOST) * 1_000_000
    rows = _timed(rows)
    keyed = rows.where(F.col(key).isNotNull()) if key else rows.withColumn("_all", F.lit(0))
    key = key or "_all"
    order = [c for c in ("Timestamp", "line_no", "EventTemplate") if c in rows.columns]
    ranked = numbered(keyed, order, "_pos", [key])
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    windows = volume_windows(keyed.select(key, micros_between(epoch, F.col("Timestamp")).alias("_us")), key, target, low, high)
    each = windows.select(key, "_w", "_nth", F.explode(F.sequence("_a", "_b")).alias("_pos"))
    out = ranked.join(each, [key, "_pos"]).withColumn("Window", _plus(epoch, F.col("_w")))
    return out.drop("_pos", "_w", "_all")


def assign_windows(rows: DataFrame, config: WindowingConfig, key: str | None = None) -> DataFrame:
    """rows with their windows by the config's strategy."""
    check_strategy(config.strategy)
    if config.strategy == "fixed":
        return fixed_windows(rows, config.window_size)
    if config.strategy == "sliding":
        return sliding_windows(rows, config.window_size, config.step_size)
    if config.strategy == "session":
        starts = Window.partitionBy(*([key] if key else []), "SessionId")
        return session_windows(rows, config.session_timeout, key).withColumn("Window", F.min("Timestamp").over(starts))
    return adaptive_windows(
        rows, config.target_logs_per_window, config.min_window_size, config.max_window_size, key
    )


def window_table(assigned: DataFrame, key: str | None = None) -> DataFrame:
    """One row per window of assigned rows: bounds, count, and its rows' lists in time order.

    Bounds are the first and last event's times, but for sliding windows the window's own.
    """
    keys = [key] if key else []
    names = assigned.columns
    if "SessionId" in names:
        group = [*keys, "SessionId"]
    else:
        group = [*keys, "Window", *(["_nth"] if "_nth" in names else [])]
    order = [c for c in ("Timestamp", "line_no") if c in names]
    fields = [c for c in ("EventTemplate", "TemplateId", "LogLevel") if c in names]
    sliding = "_start" in names
    rows = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    start, end = (F.min("_start"), F.max("_end")) if sliding else (F.min("Timestamp"), F.max("Timestamp"))
    found = assigned.groupBy(*group).agg(
        start.alias("WindowStart"), end.alias("WindowEnd"), F.count("*").alias("LogCount"), rows.alias("_rows"),
        *([F.min("Timestamp").alias("Window")] if "SessionId" in names else []),
    )

    def of(field: str, kind: str) -> Column:
        return F.col(f"_rows.{field}") if field in fields else F.array().cast(f"array<{kind}>")

    lists = {
        "EventTemplates": of("EventTemplate", "string"),
        "TemplateIds": of("TemplateId", "bigint"),
        "LogLevels": of("LogLevel", "string"),
    }
    return found.select(
        *keys, *(["SessionId"] if "SessionId" in names else []), "Window", *[c.alias(n) for n, c in lists.items()],
        "WindowStart", "WindowEnd", "LogCount",
    )
