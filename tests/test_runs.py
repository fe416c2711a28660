import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalog import cli
from stratalog.config import OutputConfig, ParsingConfig, PipelineConfig, PreprocessingConfig, WindowingConfig, DatasetConfig, config_from, load_config, save_config
from stratalog.operators.windows import fixed_windows
from stratalog.plans.pipeline import STAGES, BatchPipeline
from stratalog.sources import readers, replay, writers
from stratalog.streaming import pipeline as S

PATTERN = r"\[(?P<Timestamp>.+?)\]\s+\[(?P<LogLevel>\w+)]\s+(?P<Content>.+)"
FORMAT = "%a %b %d %H:%M:%S %Y"


def lines(n=40):
    return [f"[Sun Dec 04 04:{k % 60:02d}:44 2005] [{'error' if k % 7 == 0 else 'notice'}] worker {k} did {'x' if k % 3 else 'y'}" for k in range(n)]


def config(folder, **windowing):
    return PipelineConfig(
        DatasetConfig(path=f"{folder}/a.log"), PreprocessingConfig(PATTERN, FORMAT),
        ParsingConfig(masking_rules=[{"regex_pattern": r"\d+", "mask_with": "NUM"}]),
        WindowingConfig(**windowing), output=OutputConfig(directory=f"{folder}/out", formats=["parquet", "csv", "json", "odd"]),
    )


def test_text_keeps_line_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\r\n  \nt\xffwo\nthree")
    got = readers.read_text(spark, f"file://{tmp_path}/a.log").orderBy("line_no").collect()
    assert [(r.raw_log, r.line_no) for r in got] == [("one", 1), ("two", 2), ("three", 3)]
    (tmp_path / "b.log").write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        big = readers.read_text(spark, f"file://{tmp_path}/b.log")
        assert big.where(F.col("raw_log") != F.concat(F.lit("line "), (F.col("line_no") - 1).cast("string"))).count() == 0
        assert big.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "x long, raw_log string")
    rows.toPandas().to_csv(tmp_path / "a.csv", index=False)
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "raw_log": "a"}]))
    rows.write.parquet(f"file://{tmp_path}/a.parquet")
    for kind in ("csv", "json", "parquet"):
        got = readers.load_dataset(spark, DatasetConfig(path=f"file://{tmp_path}/a.{kind}", format="auto")).first()
        assert (got.x, got.raw_log) == (1, "a")
    assert readers.detect_format("a.csv", "parquet") == "csv" and readers.detect_format("a.csv", "raw") == "raw"
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, DatasetConfig(path=f"file://{tmp_path}/none.log"))
    with pytest.raises(ValueError):
        readers.load_dataset(spark, DatasetConfig(type="inline"))


@pytest.mark.parametrize("strategy", ["fixed", "sliding", "session", "adaptive"])
def test_batch_run(spark, tmp_path, strategy):
    (tmp_path / "a.log").write_text("\n".join(lines()))
    c = config(f"file://{tmp_path}", strategy=strategy, window_size="5m", step_size="3m", session_timeout="90s", target_logs_per_window=5)
    stages, summary = BatchPipeline(spark, c, datetime(2024, 1, 1)).run()
    assert tuple(stages) == STAGES
    assert summary["total_logs"] == 40 and summary["unique_templates"] == 2 and summary["total_windows"] == stages["windowed"].count()
    matrix = stages["event_matrix"].groupBy("Window").agg(F.sum("cnt").alias("s"), F.max("LogCount").alias("n"))
    assert matrix.where("s <> n").count() == 0
    assert stages["anomalies"].where("AnomalyScore < 0").count() == 0
    assert readers.read_results(spark, f"file://{tmp_path}/out/20240101-000000").count() == summary["total_windows"]


def test_empty_run(spark, tmp_path):
    c = config(f"file://{tmp_path}", window_size="5m")
    _, summary = BatchPipeline(spark, c).run(readers.from_lines(spark, []), save=False)
    assert summary["total_logs"] == 0 and summary["anomaly_rate"] == 0


def test_config_round_trip(tmp_path):
    c = config("data", window_size="5m")
    save_config(c, tmp_path / "c.yaml")
    back = load_config(tmp_path / "c.yaml")
    assert back.dataset.path == str(tmp_path / "data/a.log") and back.parsing == c.parsing
    with pytest.raises(TypeError):
        config_from({"preprocessing": {"log_pattern": "x", "odd": 1}})
    assert config_from({"preprocessing": {"log_pattern": "x"}}).dataset.type == "inline"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_text("\n".join(lines()))
    save_config(config(f"file://{tmp_path}", window_size="5m"), tmp_path / "c.yaml")
    assert cli.main(["run", str(tmp_path / "c.yaml"), "--output-dir", f"file://{tmp_path}/other"]) == 0
    assert json.loads(capsys.readouterr().out)["total_logs"] == 40
    run = next((tmp_path / "other").iterdir())
    assert cli.main(["visualize", f"file://{run}"]) == 0
    assert cli.main(["run", str(tmp_path / "none.yaml")]) == 1


def test_appended_parts(spark, tmp_path):
    rows = spark.createDataFrame([("w", 1, ["A", "B"])], "Window string, Value long, Templates array<string>")
    for part in (rows, rows.limit(0), rows):
        writers.append_stage(part, f"file://{tmp_path}", "windowed", ["parquet", "csv", "json"])
    assert spark.read.parquet(f"file://{tmp_path}/windowed.parquet").count() == 2
    assert {r.Templates for r in readers.read_csv(spark, f"file://{tmp_path}/windowed.csv").collect()} == {"['A','B']"}


def test_chunks(spark, tmp_path):
    c = config(f"file://{tmp_path}", window_size="5m")
    p = S.ChunkPipeline(spark, c, f"file://{tmp_path}/out", datetime(2024, 1, 1))
    (tmp_path / "a.log").write_text("\n".join(lines(30)) + "\n\n")
    chunks = list(S.line_chunks(str(tmp_path / "a.log"), 12))
    assert [len(x) for x in chunks] == [12, 12, 6]
    state = p.process_stream(chunks)
    assert (state.total_logs, state.total_windows, state.remainder) == (30, 6, "")
    assert spark.read.parquet(f"file://{tmp_path}/out/windowed.parquet").agg(F.sum("LogCount")).first()[0] == 30
    state.save(str(tmp_path / "s"))
    assert S.ChunkState.load(str(tmp_path / "s")) == state
    assert S.ChunkState.load(str(tmp_path / "new")) == S.ChunkState()
    c.output.formats = ["parquet"]
    frames = [spark.createDataFrame([(x,) for x in chunk], "raw_log string") for chunk in chunks]
    again = S.ChunkPipeline(spark, c, f"file://{tmp_path}/frames", datetime(2024, 1, 1)).process_stream([*frames, frames[0].limit(0), []])
    assert (again.total_logs, again.total_windows, again.remainder) == (30, 6, "")
    both = [spark.read.parquet(f"file://{tmp_path}/{f}/windowed.parquet").select("Window", "LogCount") for f in ("out", "frames")]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))


def test_chunks_of_a_stream_that_fails_and_starts_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(k):
        (folder / f"{k}.log").write_text("\n".join(lines(60)[k * 14 : (k + 1) * 14]))
        os.utime(folder / f"{k}.log", (1e9 + k, 1e9 + k))

    for k in range(3):
        add(k)
    c = config(f"file://{tmp_path}", window_size="5m")
    c.output.formats = ["parquet"]
    p = S.ChunkPipeline(spark, c, f"file://{tmp_path}/out", datetime(2024, 1, 1))
    place, write, calls = f"file://{tmp_path}/place", S.write_stage, []

    def failing(*a):
        if a[2] == "event_matrix" and a[-1] == "chunk_no=2" and not calls:
            calls.append(a)
            raise OSError("no space")
        return write(*a)

    monkeypatch.setattr(S, "write_stage", failing)
    with pytest.raises(Exception, match="no space"):
        p.process_files(readers.stream_text(spark, f"file://{folder}", 1), place)
    assert S.ChunkState.load(f"{place}/states").batch == 0
    p.process_files(readers.stream_text(spark, f"file://{folder}", 1), place)
    add(3)
    state = p.process_files(readers.stream_text(spark, f"file://{folder}", 1), place, flush=True)
    found = spark.read.parquet(f"file://{tmp_path}/out/windowed.parquet").groupBy("Window").agg(F.sum("LogCount"), F.count("*")).collect()
    assert state.total_logs == 56 and state.total_windows == len(found) and state.remainder == ""
    assert sorted(r[1] for r in found)[-1] == 5 and sum(r[1] for r in found) == 56 and {r[2] for r in found} == {1}


def test_streamed_counts_and_flush(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.log").write_text("\n".join(lines(40)[k * 14 : (k + 1) * 14]))
        os.utime(folder / f"{k}.log", (1e9 + k, 1e9 + k))  # files stream in order of age
    c = config(f"file://{tmp_path}", window_size="5m")
    stream = S.masked_stream(S.parsed_stream(readers.stream_text(spark, f"file://{folder}", 1), c.preprocessing), c.parsing)
    q = S.start(S.window_counts(stream, "5m", "0 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    emitted = spark.read.parquet(f"file://{tmp_path}/out/event_matrix.parquet")
    lines_ = readers.read_text(spark, f"file://{folder}")
    batch = S.masked_stream(S.parsed_stream(lines_.drop("line_no"), c.preprocessing), c.parsing)
    owed = S.flush_counts(batch, emitted, "5m")
    both = emitted.unionByName(owed.select(*emitted.columns))
    expected = fixed_windows(batch, "5m").groupBy("Window", "EventTemplate").agg(F.count("*").alias("cnt"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, expected.collect()))
    assert owed.count() > 0 and emitted.count() > 0


def test_streamed_miner(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.log").write_text("\n".join(lines(20)))
    c = config(f"file://{tmp_path}", window_size="5m")
    stream = S.parsed_stream(readers.stream_text(spark, f"file://{folder}", 1), c.preprocessing).withColumn("datastream", F.lit("a"))
    q = S.mined_stream(stream, c.parsing).writeStream.format("memory").queryName("mined").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("mined").collect()
    assert len(got) == 40 and {r.TemplateId for r in got} == {1}


def test_replay(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(lines(5)) + "\n\nno time\n")
    spark.dataSource.register(replay.LogReplay)
    s = (
        spark.readStream.format("log_replay").option("path", str(tmp_path / "a.log")).option("datastream", "a").option("timestampRegex", r"\[(?P<ts>.+?)\]")
        .option("timestampFormat", FORMAT).option("speed", "60").option("wallStart", "2024-01-01T00:00:00").load()
    )
    q = s.writeStream.format("memory").queryName("replayed").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("replayed").collect()
    assert [r.timestamp for r in got[:3]] == ["2024-01-01T00:00:00", "2024-01-01T00:00:01", "2024-01-01T00:00:02"]
    assert len(got) == 6 and got[5].original_timestamp is None
    assert replay.replay_time(datetime(2024, 1, 2), datetime(2024, 1, 1), datetime(2025, 1, 1), 24) == datetime(2025, 1, 1, 1)


def test_sending_retries():
    waits, sent = [], []

    class Sock:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def sendall(self, b):
            sent.append(b)

    tries = iter([OSError(), OSError(), None])

    def connect():
        if e := next(tries):
            raise e
        return Sock()

    replay.send_lines([{"message": "a", "original_timestamp": None}], connect, sleep=waits.append)
    assert waits == [1.0, 2.0] and sent == [b'{"message": "a"}\n']


@pytest.mark.parametrize("strict,what", [(True, "left out"), (False, "kept as they are")])
def test_unmatched_lines_are_counted_and_warned_of(spark, tmp_path, caplog, strict, what):
    c = config(f"file://{tmp_path}", window_size="5m")
    c.preprocessing.strict_mode = strict
    run = BatchPipeline(spark, c, datetime(2024, 1, 1))
    with caplog.at_level("WARNING", "stratalog"):
        run.run(readers.from_lines(spark, [*lines(20), "odd", " ", "", "odd too"]), save=False)
    assert run.unmatched() == (22, 2) and f"2 of 22 lines do not match log_pattern and are {what}" in caplog.text
    caplog.clear()
    for none in (readers.from_lines(spark, []), readers.from_lines(spark, lines(3))):
        run = BatchPipeline(spark, c, datetime(2024, 1, 1))
        run.run(none, save=False)
        assert run.unmatched(1) in (None, (0, 0), (3, 0)) and not caplog.text
