"""How well flags and scores fit the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.scans import scan


def ground_truth(rows: DataFrame, alert: Column) -> DataFrame:
    """(Window, HasAlert): whether any row of a window is an alert."""
    return rows.groupBy("Window").agg(F.bool_or(alert).alias("HasAlert"))


def evaluation_rows(anomalies: DataFrame, windows: DataFrame, truth: DataFrame) -> DataFrame:
    """anomalies joined to their windows and truth; windows without a truth are left out."""
    return anomalies.join(windows.select("Window"), "Window", "left").join(truth, "Window", "left").na.drop(subset=["HasAlert"])


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def precision_recall_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: precision, recall, f1 (0 where undefined), and the positive rate."""
    t, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    n = rows.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(
        _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(tp + fn, F.col("n")).alias("positive_rate"),
    )


def _cumulated(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, _tp, _n, _up_tp, _up_n, _all) for each distinct score: its rows, and those of
    scores down to it."""
    t = F.col(truth).cast("boolean")
    at = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(t).alias("_tp"), F.count("*").alias("_n"))
    run = scan(at, [F.desc("threshold")], {"_up_tp": "_tp", "_up_n": "_n"})
    return run.crossJoin(F.broadcast(rows.agg(F.count_if(t).alias("_all"))))


def precision_recall_curve(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, precision, recall) for each distinct score, from the highest. Scores are
    counted first; the running sums over distinct scores are a scan."""
    recall = _share(F.col("_up_tp"), F.col("_all")).alias("recall")
    return _cumulated(rows, truth, score).select("threshold", (F.col("_up_tp") / F.col("_up_n")).alias("precision"), recall)


def pr_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from (recall 0, precision 1). The
    point before one has the sums without its own rows."""
    tp, n = F.col("_up_tp") - F.col("_tp"), F.col("_up_n") - F.col("_n")
    p0, p1 = F.when(n > 0, tp / n).otherwise(1.0), F.col("_up_tp") / F.col("_up_n")
    width = _share(F.col("_tp"), F.col("_all"))
    area = _cumulated(rows, truth, score).select((width * (p0 + p1) / 2).alias("_a"))
    return area.agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("pr_auc"))
