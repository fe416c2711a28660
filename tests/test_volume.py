"""Volume windows against a walk through the sorted times, window by window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import volume, windows


def walk(times, target, least, most):
    """(start time, first row, last row, start) of each window."""
    times, n, i, out = np.array(sorted(times)), len(times), 0, []
    while i < n:
        a, b = i, min(i + target, n)
        span = times[b - 1] - times[i]
        if (span < least and b < n) or span > most:
            reach = least if span < least else most
            a = int(np.searchsorted(times, times[i], "left"))
            b = int(np.searchsorted(times, times[i] + reach, "right"))
        out.append((int(times[i]), a, b - 1, i))
        i += b - a
    return out


CASES = {
    "even": [5 * i for i in range(400)], "bursts": [t for k in range(12) for t in [1000 * k] * (k * 7 + 1) + list(range(1000 * k, 1000 * k + 40))],
    "one time": [7] * 333, "one": [3], "two": [3, 900_000], "random": [random.Random(4).randrange(3000) for _ in range(700)],
}


@pytest.mark.parametrize("target, least, most, block", [(10, 60, 400, 32), (100, 0, 300, 50), (5, 200, 90, 40), (3, 0, 0, 7), (50, 10, 10**6, 10_000)])
def test_against_a_walk(spark, target, least, most, block):
    rows = [(k, t) for k, ts in CASES.items() for t in ts]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stream string, _us long").repartition(5)
    got = {}
    for r in volume.volume_windows(df, "stream", target, least, most, block).collect():
        got.setdefault(r.stream, []).append((r._nth, (r._w, r._a, r._b, r._at)))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(walk(ts, target, least, most))) for k, ts in CASES.items()}


def test_rows_of_windows(spark):
    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("Timestamp"), F.col("id").alias("line_no"))
    found = windows.window_table(windows.adaptive_windows(rows, 100, "1m", "1h")).collect()
    assert sum(r.LogCount for r in found) == 1000 and windows.adaptive_windows(rows.limit(0), 100).count() == 0
