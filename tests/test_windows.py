import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalog.config import WindowingConfig
from stratalog.operators import windows as W

T0 = datetime(2024, 1, 1)
SCHEMA = "Timestamp timestamp_ntz, EventTemplate string, TemplateId long, line_no long"


def rows_at(spark, seconds, names=None):
    data = [(T0 + timedelta(seconds=s), (names or "A" * len(seconds))[i], 1, i + 1) for i, s in enumerate(seconds)]
    return spark.createDataFrame(data, SCHEMA)


def table(spark, seconds, **config):
    return W.window_table(W.assign_windows(rows_at(spark, seconds), WindowingConfig(**config))).orderBy("Window").collect()


def test_golden_scenarios(spark):
    assert len(table(spark, [0, 120, 390], strategy="sliding", window_size="5m", step_size="2m")) == 4
    assert len(table(spark, [0, 30, 180, 450, 600], strategy="adaptive", target_logs_per_window=2, min_window_size="2m", max_window_size="6m")) == 3


def test_sliding_keeps_the_tail(spark):
    found = table(spark, [0, 120, 360, 540], strategy="sliding", window_size="5m", step_size="5m")
    assert sum(r.LogCount for r in found) == 4
    assert found[-1].WindowStart <= T0 + timedelta(seconds=540) < found[-1].WindowEnd


@pytest.mark.parametrize("size, step", [("5m", "2m"), ("3m", "5m"), ("1m", "1m")])
def test_sliding_against_a_direct_model(spark, size, step):
    random.seed(4)
    at = sorted(random.randrange(3000) for _ in range(60))
    w, s = W.parse_duration(size), W.parse_duration(step)
    expected, start = {}, at[0]
    while start <= at[-1]:
        if n := sum(start <= t < start + w for t in at):
            expected[T0 + timedelta(seconds=start)] = n
        start += s
    got = {r.Window: r.LogCount for r in table(spark, at, strategy="sliding", window_size=size, step_size=step)}
    assert got == expected


def test_session_over_slices(spark):
    random.seed(5)
    at = [0]
    for _ in range(300):
        at.append(at[-1] + random.choice([1, 30, 59.5, 60, 60.9, 61, 4000, 9000]))
    expected, n = [], 0
    for i, t in enumerate(at):
        n += i == 0 or int(t - at[i - 1]) > 60
        expected.append(n)
    got = W.session_windows(rows_at(spark, at), "60s").orderBy("line_no").collect()
    assert [r.SessionId for r in got] == expected


def walk(at, target, least, most):
    """Row numbers of each window, by the rule read out row by row."""
    out, i = [], 0
    while i < len(at):
        members = list(range(i, min(i + target, len(at))))
        span = at[members[-1]] - at[i]
        if span < least and members[-1] + 1 < len(at):
            members = [k for k, t in enumerate(at) if at[i] <= t <= at[i] + least]
        elif span > most:
            members = [k for k, t in enumerate(at) if at[i] <= t <= at[i] + most]
        out.append((at[i], members))
        i += len(members)
    return out


def test_adaptive_against_a_direct_model(spark):
    random.seed(6)
    for _ in range(4):
        at = sorted(random.randrange(400) for _ in range(random.randint(1, 80)))
        target, least, most = random.randint(1, 9), random.randint(0, 40), random.randint(40, 90)
        rows = W.adaptive_windows(rows_at(spark, at), target, f"{least}s", f"{most}s")
        got = sorted((r._nth, r.Window, sorted(r.m)) for r in rows.groupBy("_nth", "Window").agg(F.collect_list("line_no").alias("m")).collect())
        expected = [(k, T0 + timedelta(seconds=s), [m + 1 for m in members]) for k, (s, members) in enumerate(walk(at, target, least, most))]
        assert got == expected


def test_fixed_lists_are_in_order_and_levels_empty(spark):
    rows = rows_at(spark, [10, 5, 5, 70], "ABCD")
    found = W.window_table(W.fixed_windows(rows, "1m")).orderBy("Window").collect()
    assert [r.EventTemplates for r in found] == [["B", "C", "A"], ["D"]]
    assert found[0].LogLevels == [] and found[0].WindowEnd == T0 + timedelta(seconds=10)


def test_errors(spark):
    with pytest.raises(ValueError, match="Invalid windowing strategy"):
        W.check_strategy("weekly")
    with pytest.raises(ValueError, match="Timestamp"):
        W.fixed_windows(spark.range(1), "5m")
    with pytest.raises(ValueError, match="positive"):
        W.sliding_windows(rows_at(spark, [0]), "5m", "0s")


def test_empty_and_null_times(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for s in W.STRATEGIES:
        assert W.window_table(W.assign_windows(empty, WindowingConfig(strategy=s))).count() == 0
    some = rows_at(spark, [0]).unionByName(spark.createDataFrame([(None, "A", 1, 2)], SCHEMA))
    assert W.fixed_windows(some, "5m").count() == 1
