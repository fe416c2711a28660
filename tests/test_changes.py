"""Corrections of late rows and alerts, as streams that are stopped and started again."""

import random
import tempfile
from datetime import datetime, timedelta

import pandas as pd
import pytest

from stratalog.streaming.pipeline import AlertRule, alerts, corrected_counts, folded, start

T0 = datetime(2024, 1, 1)


def feed(spark, schema, batches, make, stage, restart_after=None):
    """Rows of each batch as a file; the query runs over them one by one, and is started again."""
    folder = tempfile.mkdtemp(prefix="spark-feed-")
    cut = restart_after or len(batches)
    for some in (batches[:cut], batches[cut:]):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if some:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            start(make(source), folder, f"{folder}/checkpoint", stage).awaitTermination()
    return spark.read.parquet(f"{folder}/{stage}.parquet")


def test_corrections_of_late_rows(spark):
    rng = random.Random(2)
    rows = [(T0 + timedelta(minutes=rng.randrange(90)), rng.choice("ab")) for _ in range(200)] + [(None, "a"), (T0, None)]
    batches = [rows[i : i + 41] for i in range(0, len(rows), 41)]
    found = feed(spark, "Timestamp timestamp_ntz, EventTemplate string", batches, lambda s: corrected_counts(s, "10m"), "corrections", 3)
    changes, want = found.collect(), {}
    for t, e in rows:
        if t and e:
            key = (t - (t - T0) % timedelta(minutes=10), e)
            want[key] = want.get(key, 0) + 1
    assert {(r.Window, r.EventTemplate): r.cnt for r in folded(found).collect()} == want
    assert all(r.new > r.old for r in changes) and any(r.old for r in changes)
    assert len({(r.Window, r.EventTemplate, r.old) for r in changes}) == len(changes)


def test_corrections_within_retention(spark):
    at = lambda m: (T0 + timedelta(minutes=m), "a")
    batches = [[at(1), at(2)], [at(30)], [at(5)], [at(300)], [at(301)], [at(6)], [at(302)]]
    found = feed(spark, "Timestamp timestamp_ntz, EventTemplate string", batches, lambda s: corrected_counts(s, "10m", "1h"), "corrections")
    counts = {r.Window: r.cnt for r in folded(found).collect()}
    assert counts[T0] == 3  # minute 5 came in time, minute 6 long after
    assert counts[T0 + timedelta(minutes=30)] == 1 and counts[T0 + timedelta(minutes=300)] == 3


def plain_alerts(scores, rule):
    out, opened, told, seen = [], None, None, None
    for at, s in scores:
        if opened is not None and at - seen[0] > rule.silence:
            out.append((seen[0] + rule.silence, "close", seen[1]))
            opened = None
        if opened is None:
            if s > rule.high:
                opened = told = at
                out.append((at, "open", s))
        elif s < rule.low:
            opened = None
            out.append((at, "close", s))
        elif at - told >= rule.every:
            told = at
            out.append((at, "repeat", s))
        seen = (at, s)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_rule_against_a_plain_one(seed):
    rng, rule, at, scores = random.Random(seed), AlertRule(8, 4, every=50, silence=120), 0, []
    for _ in range(300):
        at += rng.choice([1, 10, 30, 200])
        scores.append((at, float(rng.randrange(12))))
    state, got = None, []
    for t, s in scores:
        state, some = rule.changes(state, pd.Timestamp(t * 10**9), s)
        got += [(x.value // 10**9, c, v) for x, c, v in some]
    assert got == plain_alerts(scores, rule)


def test_alerts_of_a_stream_with_restart_and_timer(spark):
    m = lambda k: T0 + timedelta(minutes=k)
    a = [(0, 1.0), (1, 9.0), (2, 6.0), (20, 9.5), (21, 3.0), (22, 9.0), (23, 9.0)]
    rows = [("a", m(k), s) for k, s in a]
    batches = [rows[:2] + [("b", m(0), 1.0)], rows[2:4] + [("a", m(1), 0.0)], rows[4:], [("b", m(500), 2.0)], [("b", m(501), 2.0)], [("b", m(502), 2.0)]]
    rule = AlertRule(8, 4, every=600, silence=3600)
    found = feed(spark, "datastream string, Window timestamp_ntz, AnomalyScore double", batches, lambda s: alerts(s, rule), "alerts", 2)
    got = sorted((r.Window, r.change, r.AnomalyScore) for r in found.collect())
    assert got == [(m(1), "open", 9.0), (m(20), "repeat", 9.5), (m(21), "close", 3.0), (m(22), "open", 9.0), (m(83), "close", 9.0)]
