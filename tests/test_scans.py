import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import evaluate, scans, views


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("n, parts", [(0, 4), (1, 4), (500, 7)])
def test_scan_against_loops(spark, n, parts):
    rng = random.Random(n)
    rows = [(rng.choice("abbbb"), rng.randrange(40), rng.choice([None, 1, 5, 9]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, v int, i int").repartition(parts)
    got = scans.scan(df, ["t", "i"], {"total": "v"}, number="nth", previous={"was": "v"}).collect()
    ordered, total, before = sorted(rows, key=lambda r: (r[1], r[3])), 0, None
    want = []
    for nth, r in enumerate(ordered):
        total += r[2] or 0
        want.append((*r, total, nth, before))
        before = r[2]
    assert sorted(((*r[:4], r.total or 0, r.nth, r.was) for r in got), key=str) == sorted(want, key=str)
    keyed = scans.scan(df, ["t", "i"], {"total": F.coalesce("v", F.lit(0))}, ["k"], "nth", {"was": "i"}).collect()
    for k in "ab":
        mine = [r for r in ordered if r[0] == k]
        own = sorted((r for r in keyed if r.k == k), key=lambda r: r.nth)
        assert [r.i for r in own] == [r[3] for r in mine]
        assert [r.total for r in own] == np.cumsum([r[2] or 0 for r in mine]).tolist() and [r.was for r in own] == [None, *(r[3] for r in mine)][: len(mine)]


def test_ties_get_one_order(spark):
    df = spark.createDataFrame([(1,)] * 300 + [(None,)] * 20, "t int").repartition(9)
    assert sorted(r.n for r in scans.numbered(df, ["t"], "n").collect()) == list(range(320))


def test_quantiles_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(scans, "FEW", 5)
    monkeypatch.setattr(scans, "RANGES", 8)
    rng = np.random.default_rng(3)
    groups = {"a": rng.lognormal(0, 4, 700), "b": np.repeat([1.0, 2.0, 7.5], [300, 1, 99]), "c": np.array([4.25]), None: rng.integers(0, 9, 60).astype(float), "z": 10.0 ** rng.integers(-300, 300, 200)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    shares = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    got = {(r.g, r.share): r.value for r in scans.quantiles(df, "g", "v", shares).collect()}
    assert set(got) == {(g, float(q)) for g in groups for q in shares}
    for (g, q), v in got.items():
        assert np.isclose(v, np.quantile(groups[g], q), rtol=1e-12), (g, q)


def test_no_window_over_all_rows(spark):
    e = spark.range(200).select((F.col("id") % 3 == 0).alias("t"), (F.col("id") % 50).cast("double").alias("s"))
    plans = [evaluate.precision_recall_curve(e, "t", "s"), evaluate.pr_auc(e, "t", "s"), views.box_by_class(e.select(F.col("t").alias("IsAnomaly"), F.col("s").alias("AnomalyScore")))]
    for p in plans:
        text = plan_of(p)
        for window in re.findall(r"\) Window\n(?:.*\n)*?Arguments: (.*)", text):
            assert "_scan_part" in window, window  # by range, never over all rows
        assert p.count() > 0
