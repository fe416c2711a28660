"""The questions that dashboards ask of stored records (ts, datastream, EventTemplate, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.patterns import to_java
from stratalog.operators.scans import quantiles


def label_matches(name: str, pattern: str) -> Column:
    """Whether a whole label fits a pattern."""
    return F.col(name).cast("string").rlike(f"{to_java(pattern, anchored=True)}\\z")


def select_stream(
    records: DataFrame, datastream: str = ".+", template: str = ".*", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Records of matching streams and templates in the time range [start, end)."""
    out = records.where(label_matches("datastream", datastream) & label_matches("EventTemplate", template))
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return out.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else out


def volume_by_template(records: DataFrame, step: str) -> DataFrame:
    """(step_start, EventTemplate, n): counts per step."""
    return records.groupBy(F.window("ts", step).start.alias("step_start"), "EventTemplate").agg(F.count("*").alias("n"))


def count_by(records: DataFrame, *labels: str) -> DataFrame:
    return records.groupBy(*labels).agg(F.count("*").alias("n"))


def top_templates(records: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent (datastream, TemplateId); ties go by label."""
    return count_by(records, "datastream", "TemplateId").orderBy(F.desc("n"), "datastream", "TemplateId").limit(k)


def top_templates_by_step(records: DataFrame, step: str, k: int = 5) -> DataFrame:
    """The k most frequent (datastream, TemplateId) of each step."""
    n = records.groupBy(F.window("ts", step).start.alias("step_start"), "datastream", "TemplateId").agg(F.count("*").alias("n"))
    over = Window.partitionBy("step_start").orderBy(F.desc("n"), "datastream", "TemplateId")
    return n.withColumn("_r", F.row_number().over(over)).where(F.col("_r") <= k).drop("_r")


def live_tail(records: DataFrame, k: int, *ties: str) -> DataFrame:
    return records.orderBy(F.desc("ts"), *[F.desc(t) for t in ties]).limit(k)


def label_values(records: DataFrame, label: str) -> DataFrame:
    return records.select(F.col(label).cast("string").alias("value")).distinct()


def template_mapping(records: DataFrame) -> DataFrame:
    """Count of each (datastream, TemplateId, EventTemplate), under the panel's titles."""
    return count_by(records, "datastream", "TemplateId", "EventTemplate").withColumnRenamed("n", "Count")


def top_anomalies(anomalies: DataFrame, k: int = 5) -> DataFrame:
    return anomalies.where("IsAnomaly").orderBy(F.desc("AnomalyScore"), "Window").limit(k)


def score_series(anomalies: DataFrame) -> DataFrame:
    """(Window, AnomalyScore, IsAnomaly, line): line is 0.95 of the least flagged score."""
    line = anomalies.where("IsAnomaly").agg((F.min("AnomalyScore") * 0.95).alias("line"))
    return anomalies.select("Window", "AnomalyScore", "IsAnomaly").crossJoin(F.broadcast(line))


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin from 0, low, high, n, mean) of equal bins between the extremes, empty ones too; the
    last is closed. mean is that of all values."""
    value = F.col(column).cast("double")
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("mean")).where("_lo IS NOT NULL")
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((value - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    binned = rows.where(value.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    low = F.col("_lo") + F.col("bin") * width
    return every.join(F.broadcast(binned), "bin", "left").select(
        "bin", low.alias("low"), (low + width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean"
    )


def count_and_score(anomalies: DataFrame) -> DataFrame:
    """(LogCount, AnomalyScore, IsAnomaly) of each window: the dashboard's volume-against-score
    panel."""
    return anomalies.select("Window", "LogCount", "AnomalyScore", "IsAnomaly")


def box_by_class(anomalies: DataFrame) -> DataFrame:
    """Five-number summary of scores by flag, exact, without a task that holds a class's scores."""
    names = {0.0: "least", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "most"}
    found = quantiles(anomalies, "IsAnomaly", "AnomalyScore", list(names))
    return found.groupBy("IsAnomaly").agg(*(F.max(F.when(F.col("share") == q, F.col("value"))).alias(n) for q, n in names.items()))


def feature_variances(counts: DataFrame, k: int = 15) -> DataFrame:
    """The k templates whose counts vary most over windows (sample variance, absent being 0)."""
    n = counts.select("Window").distinct().agg(F.count("*").alias("_n"))
    sums = counts.groupBy("EventTemplate").agg(F.sum("cnt").alias("_s"), F.sum(F.col("cnt") * F.col("cnt")).alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    found = sums.crossJoin(F.broadcast(n)).select("EventTemplate", var.alias("variance"))
    return found.orderBy(F.desc("variance"), "EventTemplate").limit(k)


def heat_map(counts: DataFrame, k: int = 15) -> DataFrame:
    """(Window, EventTemplate, cnt) of the most varying templates."""
    return counts.join(F.broadcast(feature_variances(counts, k).select("EventTemplate")), "EventTemplate", "left_semi")
