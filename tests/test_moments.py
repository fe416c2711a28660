import random
import tempfile

import pytest

from stratalog.config import AnomalyConfig
from stratalog.operators.scoring import fit_detector
from stratalog.streaming.moments import MomentStore, scored_stream

SCHEMA = "Window long, EventTemplate string, cnt long"


def windows(n, seed=3):
    rng = random.Random(seed)
    return {w: [(w, t, rng.randrange(1, 9 + 3 * k)) for k, t in enumerate("abcdefg") if rng.random() < 0.8 or t == "a"] for w in range(n)}


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_any_cutting_gives_the_model_of_all(spark, cuts):
    config, data, rng = AnomalyConfig(variance_threshold=0.7), windows(60), random.Random(cuts)
    store = MomentStore(spark, tempfile.mkdtemp(prefix="spark-moments-"))
    batches = [[] for _ in range(cuts)]
    for rows in data.values():
        batches[rng.randrange(cuts)] += rows
    for k, rows in enumerate(batches):
        store.add(spark.createDataFrame(rows, SCHEMA), k)
    store.add(spark.createDataFrame(batches[0], SCHEMA), 0)  # run again after a failure
    every = spark.createDataFrame([r for rows in data.values() for r in rows], SCHEMA)
    got, want = ({r.Window: r for r in d.score(every).collect()} for d in (store.detector(config), fit_detector(every, config)))
    assert set(got) == set(want) == set(data)
    assert all(abs(got[w].AnomalyScore - want[w].AnomalyScore) < 1e-8 and got[w].IsAnomaly == want[w].IsAnomaly for w in data)


def test_stream_with_restart(spark):
    config, data = AnomalyConfig(variance_threshold=0.7), windows(30)
    folder = tempfile.mkdtemp(prefix="spark-moments-")
    store = MomentStore(spark, folder)
    assert store.detector(config) is None
    for part in (range(0, 1), range(1, 30)):
        for w in part:
            if w % 10 == 1 or w == 0:
                some = [r for k in range(w, min(w + 10, 30)) if k == w or w for r in data[k]]
                spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        scored_stream(stream, store, config, f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/scores").collect()
    assert sorted(r.Window for r in found) == list(range(30)) and {r.Window: r.AnomalyScore for r in found}[0] == 0
    every = spark.createDataFrame([r for rows in data.values() for r in rows], SCHEMA)
    want = {r.Window: r.AnomalyScore for r in fit_detector(every, config).score(every).collect()}
    last = {r.Window: r.AnomalyScore for r in found if r.Window > 20}
    assert all(abs(want[w] - s) < 1e-8 for w, s in last.items())
