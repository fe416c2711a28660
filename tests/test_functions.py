import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalog.functions.durations import parse_duration, positive_duration
from stratalog.functions.patterns import UnsupportedPattern, group_names, match_groups, matches, named_groups, strip, to_java
from stratalog.functions.times import parse_time


@pytest.mark.parametrize("text, seconds", [("5m", 300), ("30 seconds", 30), ("1H", 3600), ("2 days", 172800), ("1h30m", 5400), ("0s", 0)])
def test_durations(text, seconds):
    assert parse_duration(text) == seconds


@pytest.mark.parametrize("text", ["", "5", "m", "1.5h", "5 parsecs", "5m!"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)
    with pytest.raises(ValueError):
        positive_duration("0s", "step_size")


def test_patterns_match_as_in_python(spark):
    pattern = r"(?P<a>\w+)\s+(?P<b>\d+)?(?P<rest>.*)$"
    texts = ["ab 12 x", "é x", "ab  ", " ab", "a ١٢y", "x  1 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", matches(F.col("t"), pattern).alias("hit"), *[c.alias(n) for n, c in named_groups(match_groups(F.col("t"), pattern), pattern).items()]).collect()
    for r in got:
        m = re.match(pattern, r.t)
        assert r.hit == bool(m)
        if m:
            assert (r.a, r.b, r.rest) == (m["a"], m["b"], m["rest"]), r
    assert group_names(pattern) == ["a", "b", "rest"]


def test_pattern_errors():
    with pytest.raises(re.error):
        to_java("(")
    with pytest.raises(UnsupportedPattern):
        to_java(r"(a)?(?(1)b|c)")


def test_strip(spark):
    r = spark.createDataFrame([("　 a b\t\n",)], "t string").select(strip(F.col("t")).alias("x")).first()
    assert r.x == "a b"


@pytest.mark.parametrize(
    "fmt, texts",
    [
        ("%a %b %d %H:%M:%S %Y", ["Sun Dec 04 04:47:44 2005", "sun dec 4 04:47:44 2005", "Sun Foo 04 04:47:44 2005"]),
        ("%Y-%m-%d-%H.%M.%S.%f", ["2005-06-03-15.42.50.675872", "2005-06-31-15.42.50.675872", "2005-06-03"]),
        ("%y%m%d %H%M%S", ["081109 203518", "690101 000000", "991231 235959", "081109"]),
        ("%Y-%m-%d %H:%M:%S.%f", ["2017-05-16 00:00:00.008", "2017-05-16 00:00:00.5", "2017-02-30 00:00:00.5"]),
        ("%b %d %H:%M:%S", ["Nov 09 12:01:01", "Feb 30 00:00:00"]),
        ("%d/%B/%Y %I:%M %p", ["01/March/2020 12:30 AM", "01/march/2020 12:30 pm"]),
    ],
)
def test_times_parse_as_in_python(spark, fmt, texts):
    def python(t):
        try:
            return datetime.strptime(t, fmt)
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_time(F.col("t"), fmt).alias("x"))
    for r in rows.collect():
        assert r.x == python(r.t), r.t


def test_unix_and_unknown_times(spark):
    r = spark.createDataFrame([("1117838570.5",), ("x",)], "t string").select(parse_time(F.col("t"), "unix").alias("x")).collect()
    assert r[0].x == datetime(2005, 6, 3, 22, 42, 50, 500000) and r[1].x is None
    with pytest.raises(ValueError):
        parse_time(F.col("t"), "%j")
