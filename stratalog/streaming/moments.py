"""Scores of a stream of windows by a model that goes with it.

What a fit needs are sums: of windows, of each template's counts, and of the products of every
two templates' counts in a window. They add up over batches in any order, so each micro-batch
leaves its own, in a table of its own name: a batch that is run again after a failure
replaces what it left, and after any cutting of the input a model is that of one fit to all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.config import AnomalyConfig
from stratalog.operators.scoring import MOST_FEATURES, FittedDetector, model_of

_SUMS = "a string, b string, value double"


def window_sums(counts: DataFrame) -> DataFrame:
    """(a, b, value) of counts(Window, EventTemplate, cnt): sums of products of a's and b's counts, a
    before b or the same; of a's counts where b is null; of windows where both are null."""
    each = counts.groupBy("Window", "EventTemplate").agg(F.sum("cnt").cast("double").alias("x"))
    left, right = each.select("Window", F.col("EventTemplate").alias("a"), "x"), each.select("Window", F.col("EventTemplate").alias("b"), F.col("x").alias("y"))
    products = left.join(right, "Window").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    none = F.lit(None).cast("string")
    sums = left.groupBy("a").agg(F.sum("x").alias("value")).select("a", none.alias("b"), "value")
    n = each.agg(F.count_distinct("Window").cast("double").alias("value")).select(none.alias("a"), none.alias("b"), "value")
    return products.select("a", "b", "value").unionByName(sums).unionByName(n)


@dataclass
class MomentStore:
    """The sums of all batches so far, a folder each below folder, which all executors see."""

    spark: SparkSession
    folder: str

    def add(self, counts: DataFrame, batch: int) -> None:
        """Leave the sums of a batch's windows, each of which comes whole in one batch."""
        window_sums(counts).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch}")

    def sums(self) -> DataFrame:
        """(a, b, value) over all batches."""
        try:
            stored = self.spark.read.schema(f"{_SUMS}, batch long").parquet(f"{self.folder}/sums")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], f"{_SUMS}, batch long")
        return stored.groupBy("a", "b").agg(F.sum("value").alias("value"))

    def detector(self, config: AnomalyConfig) -> FittedDetector | None:
        """The model of all windows so far, None for fewer than two. Its square matrix is held by the
        driver, so templates are counted first."""
        sums = self.sums()
        names = [r.a for r in sums.where("a IS NOT NULL AND b IS NULL").select("a").orderBy("a").limit(MOST_FEATURES + 1).collect()]
        if len(names) > MOST_FEATURES:
            raise ValueError(f"a kept detector has at most {MOST_FEATURES} templates")
        at, p, n = {x: i for i, x in enumerate(names)}, len(names), 0
        total, products = np.zeros(p), np.zeros((p, p))
        for a, b, value in sums.toLocalIterator():
            if a is None:
                n = int(value)
            elif b is None:
                total[at[a]] = value
            else:
                products[at[a], at[b]] = products[at[b], at[a]] = value
        model = model_of(n, total, products, config) if p else None
        return FittedDetector(names, model) if model else None


def scored_stream(counts: DataFrame, store: MomentStore, config: AnomalyConfig, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query over a stream of counts(Window, EventTemplate, cnt) that keeps the store and
    writes (Window, AnomalyScore, IsAnomaly) of each batch, by the model that has seen it too, to
    scores/batch=... below the store's folder. Windows before there is a model score 0."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        store.add(batch, number)
        detector = store.detector(config)
        if detector:
            found = detector.score(batch)
        else:
            found = batch.select("Window").distinct().select("Window", F.lit(0.0).alias("AnomalyScore"), F.lit(False).alias("IsAnomaly"))
        found.write.mode("overwrite").parquet(f"{store.folder}/scores/batch={number}")
        batch.unpersist()

    writer = counts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
