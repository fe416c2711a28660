import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stratalog.config import AnomalyConfig, DatasetConfig, ParsingConfig, PreprocessingConfig, WindowingConfig
from stratalog.plans import stages as S
from stratalog.sources.readers import from_lines, load_dataset
from stratalog.sources.writers import write_stage
from stratalog.streaming.progress import RunCounters


class Shout(S.Stage):
    def transform(self, rows):
        return rows.withColumn("Content", F.upper("Content"))


def test_stages_chain_with_own_ones(spark):
    lines = from_lines(spark, [f"2024-01-01 00:{m:02d}:00 job {m} done" for m in range(30)])
    pattern = PreprocessingConfig(r"(?P<Timestamp>\S+ \S+) (?P<Content>.*)", "%Y-%m-%d %H:%M:%S", strict_mode=True)
    masks = ParsingConfig(masking_rules=[{"regex_pattern": r"\d+", "mask_with": "N"}])
    steps = [S.Preprocess(pattern), Shout(None), S.Templates(masks), S.Windowing(WindowingConfig(window_size="10m")), S.EventMatrix(None)]
    counts = S.chained(lines.drop("line_no"), steps)
    assert [(r.EventTemplate, r.cnt) for r in counts.collect()] == [("JOB <:N:> DONE", 10)] * 3
    assert S.Detector(AnomalyConfig()).transform(counts).count() == 3


def test_configs_are_checked():
    with pytest.raises(ValueError):
        S.Windowing(WindowingConfig(strategy="odd"))
    with pytest.raises(ValueError):
        S.Detector(AnomalyConfig(algorithm="odd"))
    with pytest.raises(ValueError):
        S.Preprocess(PreprocessingConfig("no groups"))


def test_alignment_and_union(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3)], "a int, c int")
    schema = StructType([StructField("c", LongType()), StructField("a", StringType())])
    assert [tuple(r) for r in S.aligned(a, schema).collect()] == [(None, "1")]
    assert sorted(map(tuple, S.relaxed_union([a, b]).collect()), key=str) == [(1, "x", None), (2, None, 3)]


def test_counters(spark, tmp_path):
    counters = RunCounters()
    spark.streams.addListener(counters)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.log").write_text("a\nb\n")
        q = spark.readStream.text(f"file://{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if counters.rows:
                break
            import time

            time.sleep(0.2)
        assert counters.rows == 2 and counters.batches == 1
    finally:
        spark.streams.removeListener(counters)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_times_are_stored_with_their_microseconds(spark, tmp_path, fmt):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00.123456' AS n, TIMESTAMP'2024-01-01 10:00:00.000001' AS z")
    found = load_dataset(spark, DatasetConfig(path=write_stage(rows, str(tmp_path), "t", fmt), format=None))
    got = found.select(F.col("n").cast("timestamp_ntz").cast("string"), F.col("z").cast("timestamp").cast("string")).first()
    assert tuple(got) == ("2024-01-01 10:00:00.123456", "2024-01-01 10:00:00.000001")
