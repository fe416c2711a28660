"""The same stages over streams of lines."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass, fields, replace
from datetime import datetime

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.config import ParsingConfig, PipelineConfig, PreprocessingConfig
from stratalog.functions.durations import positive_duration
from stratalog.operators.matrix import event_counts
from stratalog.operators.preprocess import parse_lines
from stratalog.operators.templates import TemplateTree, extract_templates, masked, parameters, tokens
from stratalog.operators.windows import assign_windows, fixed_windows, window_table
from stratalog.plans.pipeline import scored
from stratalog.sources.readers import from_lines
from stratalog.sources.writers import append_stage, shared_folder, write_stage


_log = logging.getLogger("stratalog")


def parsed_stream(lines: DataFrame, config: PreprocessingConfig, clock: datetime | None = None) -> DataFrame:
    """Typed rows of a stream of raw_log; a stream has no line numbers, so they are null."""
    return parse_lines(lines.withColumn("line_no", F.lit(None).cast("long")), config, clock)


def masked_stream(rows: DataFrame, config: ParsingConfig) -> DataFrame:
    """rows with EventTemplate by masks: no state, any order."""
    return rows.where("Content IS NOT NULL").withColumn("EventTemplate", masked(F.col("Content"), config))


def _watermarked(rows: DataFrame, lateness: str) -> DataFrame:
    """rows with a watermark, which Spark keeps on zoned times: the session's zone is taken, and
    results are turned back."""
    return rows.withColumn("Timestamp", F.col("Timestamp").cast("timestamp")).withWatermark("Timestamp", lateness)


def _plain(name: str):
    return F.col(name).cast("timestamp_ntz")


def window_counts(rows: DataFrame, size: str, lateness: str = "10 minutes", keys: Sequence[str] = ("EventTemplate",)) -> DataFrame:
    """(Window, *keys, cnt) of a stream, each window once, when the watermark passes its end.
    Rows later than that are dropped (and counted by the query's progress)."""
    seconds = positive_duration(size, "window_size")
    at = F.window("Timestamp", f"{seconds} seconds")
    found = _watermarked(rows, lateness).groupBy(at.alias("_w"), *keys).agg(F.count("*").alias("cnt"))
    return found.select(_plain("_w.start").alias("Window"), *keys, "cnt")


def sliding_counts(rows: DataFrame, size: str, step: str, lateness: str = "10 minutes") -> DataFrame:
    """As window_counts for overlapping windows, which a stream aligns with the epoch."""
    at = F.window("Timestamp", f"{positive_duration(size, 'window_size')} seconds", f"{positive_duration(step, 'step_size')} seconds")
    found = _watermarked(rows, lateness).groupBy(at.alias("_w"), "EventTemplate").agg(F.count("*").alias("cnt"))
    return found.select(_plain("_w.start").alias("Window"), "EventTemplate", "cnt")


def session_counts(rows: DataFrame, timeout: str, key: str, lateness: str = "10 minutes") -> DataFrame:
    """(key, WindowStart, WindowEnd, LogCount) of sessions by key; one ends after timeout."""
    at = F.session_window("Timestamp", f"{positive_duration(timeout, 'session_timeout')} seconds")
    found = _watermarked(rows, lateness).groupBy(key, at.alias("_w")).agg(
        F.min("Timestamp").alias("WindowStart"), F.max("Timestamp").alias("WindowEnd"), F.count("*").alias("LogCount")
    )
    return found.select(key, _plain("WindowStart").alias("WindowStart"), _plain("WindowEnd").alias("WindowEnd"), "LogCount")


def corrected_counts(rows: DataFrame, size: str, retention: str | None = None) -> DataFrame:
    """(Window, EventTemplate, old, new) of a stream: a row whenever the count of a template in a
    window changes, however late its rows come. The sum of new - old is the count.

    The counts so far are the query's checkpointed state, a number each. With retention they are
    kept until the watermark, that much behind the latest row, passes the window's end; rows later than
    that are dropped by Spark and show in the query's progress.
    """
    seconds = positive_duration(size, "window_size")
    rows = rows.where("Timestamp IS NOT NULL AND EventTemplate IS NOT NULL")
    rows = _watermarked(rows, f"{positive_duration(retention, 'retention')} seconds") if retention else rows.withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    placed = rows.select(F.window("Timestamp", f"{seconds} seconds").alias("_w"), "EventTemplate")
    placed = placed.select(F.col("_w.start").alias("_start"), "EventTemplate", "_w") if retention else placed.select(F.col("_w.start").alias("_start"), "EventTemplate")

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get[0] if state.exists else 0
        new = old + sum(map(len, batches))
        state.update((new,))
        if retention:
            end = int(pd.Timestamp(key[0]).timestamp() * 1000) + seconds * 1000
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"_start": [key[0]], "EventTemplate": [key[1]], "old": [old], "new": [new]})

    timeout = GroupStateTimeout.EventTimeTimeout if retention else GroupStateTimeout.NoTimeout
    schema = "_start timestamp, EventTemplate string, old long, new long"
    found = placed.groupBy("_start", "EventTemplate").applyInPandasWithState(count, schema, "n long", "append", timeout)
    return found.select(_plain("_start").alias("Window"), "EventTemplate", "old", "new")


def folded(corrections: DataFrame) -> DataFrame:
    """(Window, EventTemplate, cnt) that corrections add up to."""
    return corrections.groupBy("Window", "EventTemplate").agg(F.sum(F.col("new") - F.col("old")).alias("cnt"))


@dataclass
class AlertRule:
    """An alert opens above high and closes below low; while open it is repeated after every so many
    seconds; without a window for silence seconds it closes."""

    high: float
    low: float
    every: int = 3600
    silence: int = 86_400

    def changes(self, state: tuple | None, window: pd.Timestamp, score: float) -> tuple[tuple | None, list[tuple]]:
        """(state, changes) after a window; state is (opened, told, seen, score) while open."""
        out = []
        if state and (window - state[2]).total_seconds() > self.silence:
            out.append((state[2] + pd.Timedelta(seconds=self.silence), "close", state[3]))
            state = None
        if not state:
            return ((window, window, window, score), [*out, (window, "open", score)]) if score > self.high else (None, out)
        if score < self.low:
            return None, [*out, (window, "close", score)]
        told = state[1]
        if (window - told).total_seconds() >= self.every:
            told, out = window, [*out, (window, "repeat", score)]
        return (state[0], told, window, score), out


def alerts(scores: DataFrame, rule: AlertRule, lateness: str = "10 minutes") -> DataFrame:
    """(datastream, Window, change, AnomalyScore) of a stream of scores(datastream, Window,
    AnomalyScore): one row for each opening, repetition and closing of a stream's alert.

    Windows of a stream come in order, as window streams give them; those before the last one seen
    are left out. A timer closes an alert when the watermark passes its silence.
    """
    rows = scores.where("Window IS NOT NULL AND AnomalyScore IS NOT NULL").select(
        F.col("datastream").cast("string").alias("datastream"), F.col("Window").cast("timestamp").alias("_at"), F.col("AnomalyScore").cast("double").alias("AnomalyScore")
    )
    stamp = lambda t: int(t.value // 1000)  # noqa: E731  microseconds
    back = lambda us: pd.Timestamp(us * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, told, seen, score, is_open = state.get if state.exists else (0, 0, None, 0.0, False)
        now = (back(opened), back(told), back(seen), score) if is_open else None
        out = []
        if state.hasTimedOut:
            out.append((back(seen) + pd.Timedelta(seconds=rule.silence), "close", score))
            now = None
        else:
            rows = pd.concat(list(batches)).sort_values("_at", kind="stable")
            for at, value in zip(rows["_at"], rows["AnomalyScore"]):
                if seen is None or stamp(at) > seen:
                    now, some = rule.changes(now, at, value)
                    seen = stamp(at)
                    out += some
        state.update((stamp(now[0]), stamp(now[1]), seen, float(now[3]), True) if now else (0, 0, seen, 0.0, False))
        if now:
            state.setTimeoutTimestamp(max(seen // 1000 + rule.silence * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            at, change, score = zip(*out)
            yield pd.DataFrame({"datastream": key[0], "_at": at, "change": change, "AnomalyScore": score})

    schema = "datastream string, _at timestamp, change string, AnomalyScore double"
    kept = "opened long, told long, seen long, score double, is_open boolean"
    found = rows.withWatermark("_at", lateness).groupBy("datastream").applyInPandasWithState(follow, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("datastream", _plain("_at").alias("Window"), "change", "AnomalyScore")


def flush_counts(rows: DataFrame, emitted: DataFrame, size: str) -> DataFrame:
    """What a bounded run still owes: counts of the windows of rows (a batch read of the same
    input) that the stream did not emit."""
    counts = event_counts(fixed_windows(rows, size))
    return counts.join(emitted.select("Window").distinct(), "Window", "left_anti")


def mined_stream(rows: DataFrame, config: ParsingConfig, stream: str = "datastream") -> DataFrame:
    """(datastream, Timestamp, Content, EventTemplate, TemplateId, Parameters): one miner per
    stream, its templates being the query's checkpointed state."""
    content = F.col("Content")
    prepared = rows.where(content.isNotNull()).select(
        F.col(stream).cast("string").alias("datastream"), "Timestamp", "Content", tokens(masked(content, config), config).alias("_words"),
    )

    def mine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tree = pickle.loads(state.get[0]) if state.exists else TemplateTree(config)
        for batch in batches:
            batch = batch.sort_values("Timestamp", kind="stable")
            ids, names = [], []
            for words in batch["_words"]:
                i, name = tree.add(list(words))
                ids.append(i)
                names.append(name)
            yield batch[["datastream", "Timestamp", "Content"]].assign(EventTemplate=names, TemplateId=ids)
        state.update((pickle.dumps(tree),))

    schema = "datastream string, Timestamp timestamp_ntz, Content string, EventTemplate string, TemplateId long"
    mined = prepared.groupBy("datastream").applyInPandasWithState(mine, schema, "tree binary", "append", GroupStateTimeout.NoTimeout)
    return mined.withColumn("Parameters", parameters(content, F.col("EventTemplate"), config))


def start(counts: DataFrame, folder: str, checkpoint: str, stage: str = "event_matrix", once: bool = True) -> StreamingQuery:
    """Append a stream of counts to a Parquet stage; what was emitted survives a restart."""
    writer = counts.writeStream.format("parquet").option("path", f"{folder}/{stage}.parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


@dataclass
class ChunkState:
    """What goes from chunk to chunk: the table of the open window's rows, and counters."""

    remainder: str = ""
    total_logs: int = 0
    total_windows: int = 0
    total_anomalies: int = 0
    chunks: int = 0
    step: int = 0
    batch: int = -1

    def save(self, path: str) -> None:
        """Add this state to the table at path, which any store that Spark writes may hold."""
        kinds = {"remainder": "string", "step": "int", "batch": "long"}
        schema = ", ".join(f"{f.name} {kinds.get(f.name, 'long')}" for f in fields(self))
        SparkSession.active().createDataFrame([astuple(self)], schema).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, path: str) -> ChunkState:
        """The latest state at path; a new one where there is none."""
        try:
            found = SparkSession.active().read.parquet(path).orderBy(F.desc("step"), F.desc("batch")).first()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            found = None
        return cls(**found.asDict()) if found else cls()


class ChunkPipeline:
    """Chunks of lines in arrival order, scored chunk by chunk. A chunk is a DataFrame with raw_log (and line_no, if
    it has an order), or a list of lines in memory.

    With fixed windows the last window of a chunk is held back and joins the next chunk: its rows
    are a table in the shared folder, which stays until the caller deletes it, and only its name is carried. Other
    strategies treat each chunk by itself. Scores are fitted on the windows of one chunk. A row
    that is later than its chunk makes its window come once more, with the late rows alone.

    Stages go to chunk_no=N below their folders, N being the number of the chunk, so that a chunk that is run again
    replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, config: PipelineConfig, folder: str | None = None, clock: datetime | None = None):
        self.spark, self.config, self.folder, self.clock = spark, config, folder, clock or datetime.now()

    def _templates(self, chunk: DataFrame | Sequence[str]) -> DataFrame:
        lines = chunk if isinstance(chunk, DataFrame) else from_lines(self.spark, list(chunk))
        if "line_no" not in lines.columns:
            lines = lines.withColumn("line_no", F.monotonically_increasing_id() + 1)
        return extract_templates(parse_lines(lines, self.config.preprocessing, self.clock), self.config.parsing)

    def _finish(self, rows: DataFrame, state: ChunkState) -> dict[str, DataFrame]:
        assigned = assign_windows(rows, self.config.windowing)
        windows, counts = window_table(assigned), event_counts(assigned)
        found = {
            "windowed": windows,
            "event_matrix": counts.join(windows.select("Window", "WindowStart", "WindowEnd", "LogCount"), "Window", "left"),
            "anomalies": scored(windows, counts, self.config),
        }
        n = found["anomalies"].agg(F.count("*"), F.coalesce(F.sum(F.col("IsAnomaly").cast("long")), F.lit(0))).first()
        state.total_windows += n[0]
        state.total_anomalies += n[1]
        if self.folder and n[0]:
            for stage, df in found.items():
                for fmt in self.config.output.formats:
                    write_stage(df, self.folder, stage, fmt, "overwrite", f"chunk_no={state.step}")
        return found

    def process_chunk(self, chunk: DataFrame | Sequence[str], state: ChunkState | None = None) -> tuple[dict[str, DataFrame], ChunkState]:
        """(stages of the windows that this chunk completes, state); no stages if there are none."""
        state = replace(state) if state else ChunkState()
        state.step += 1
        rows = self._templates(chunk).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = rows.count()
            state.total_logs += n
            if not n:
                return {}, state
            if self.config.windowing.strategy == "fixed":
                both = rows.unionByName(self.spark.read.schema(rows.schema).parquet(state.remainder)) if state.remainder else rows
                placed = fixed_windows(both, self.config.windowing.window_size)
                last, first = placed.agg(F.max("Window"), F.min("Window")).first()
                state.remainder = shared_folder(self.spark, "open-window")
                placed.where(F.col("Window") == F.lit(last)).drop("Window").write.parquet(state.remainder)
                if first == last:
                    return {}, state
                found = placed.where(F.col("Window") < F.lit(last)).drop("Window")
            else:
                found = rows
                if not state.chunks:
                    _log.warning("%s windows are cut at the ends of chunks", self.config.windowing.strategy)
            state.chunks += 1
            return self._finish(found, state), state
        finally:
            rows.unpersist()

    def flush(self, state: ChunkState) -> dict[str, DataFrame]:
        """The stages of the window that is still open."""
        if not state.remainder:
            return {}
        rows = self.spark.read.schema(self._templates([]).schema).parquet(state.remainder)
        state.remainder, state.step = "", state.step + 1
        return self._finish(rows, state)

    def process_stream(self, chunks: Iterable[DataFrame | Sequence[str]], state: ChunkState | None = None) -> ChunkState:
        state = state or ChunkState()
        for chunk in chunks:
            _, state = self.process_chunk(chunk, state)
        self.flush(state)
        return state

    def process_files(self, lines: DataFrame, place: str, flush: bool = False) -> ChunkState:
        """Run over what is new in a stream of raw_log (such as stream_text), a micro-batch a chunk.

        place keeps the query's checkpoint and the states. A run that was stopped goes on where the last
        complete chunk ended; a chunk that was under way is run again from the state before it, and
        replaces what it had written. With flush the open window is closed at the end.
        """
        states = f"{place}/states"

        def step(batch: DataFrame, number: int) -> None:
            state = ChunkState.load(states)
            if number > state.batch:
                _, state = self.process_chunk(batch, state)
                state.batch = number
                state.save(states)

        query = lines.select("raw_log").writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
        state = ChunkState.load(states)
        if flush and state.remainder:
            self.flush(state)
            state.save(states)
        return state


def line_chunks(path: str, size: int) -> Iterator[list[str]]:
    """Chunks of a raw text file's lines that are not empty."""
    chunk: list[str] = []
    with open(path, encoding="utf-8", errors="ignore") as f:
        for line in f:
            if line := line.rstrip("\r\n"):
                chunk.append(line)
                if len(chunk) == size:
                    yield chunk
                    chunk = []
    if chunk:
        yield chunk
