"""Templates of long streams: parts are mined side by side, and their template trees merged.

Messages are reduced to distinct ones first. The upper part of a tree, by the number of words
and then by the first of them, needs no order but that of first appearance, so all messages
find their leaf at once. A leaf's messages are cut into parts in order; each part is mined by
itself, and the lists of templates are merged, a few neighbours at a time, until a leaf has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.config import ParsingConfig
from stratalog.operators.preprocess import once
from stratalog.operators.scans import kept, numbered
from stratalog.operators.templates import WILDCARD, _checked, _order, masked, parameters, tokens

#: Distinct messages of a leaf that are mined in one go, and lists of templates merged at once.
PART, FAN = 20_000, 8


class TemplateList:
    """The templates of one leaf, all of one length. Lists of parts that follow each other may be
    merged in any grouping: a template joins the one of the list that it shares the most
    words with, if these are enough, and else stands behind it."""

    def __init__(self, length: int, threshold: float):
        self.length, self.threshold, self.number = length, threshold, {WILDCARD: 0}
        self.rows, self.n = np.zeros((16, length), np.int64), 0

    def add(self, words: list[str]) -> int:
        """The place of the template that takes a message or template, after it did."""
        own = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64)
        known = self.rows[: self.n]
        if self.n:
            same = (known == own).sum(1)
            best = int(np.lexsort((-np.arange(self.n), (known == 0).sum(1), same))[-1])
            if not self.length or same[best] / self.length >= self.threshold:
                known[best] = np.where(known[best] == own, own, 0)
                return best
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = own
        self.n += 1
        return self.n - 1

    def templates(self) -> list[list[str]]:
        words = list(self.number)
        return [[words[k] for k in row] for row in self.rows[: self.n].tolist()]


def leaf_paths(messages: DataFrame, config: ParsingConfig) -> DataFrame:
    """messages(stream, words, first, ...) with path: the words by which a tree of the config's
    depth leads a message to its leaf.

    A node has the first max_children different words as children, words with digits never
    being one; all others go to its wildcard. Which words come first at a node is found
    for all nodes of a level together.
    """
    out = messages.withColumns({"path": F.array().cast("array<string>"), "n": F.size("words")})
    for level in range(max(config.depth - 3, 0) + 1):
        out = out.withColumn("word", F.when(F.col("n") > level, F.get("words", F.lit(level))))
        node = ["stream", "n", "path"]
        seen = out.where(~F.col("word").rlike(r"\p{Nd}")).groupBy(*node, "word").agg(F.min("first").alias("_at"))
        place = F.row_number().over(Window.partitionBy(*node).orderBy("_at", "word"))
        known = seen.withColumn("_place", place).where(F.col("_place") <= config.max_children).select(*node, "word", F.lit(True).alias("known"))
        step = F.when(F.col("known"), F.col("word")).otherwise(WILDCARD)
        out = kept(
            out.join(known, [*node, "word"], "left")
            .withColumn("path", F.when(F.col("word").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step)))).drop("word", "known"),
            "paths",
        )
    return out


_LISTS = "leaf string, pos long, part long, place int, words array<string>, members array<struct<part:long,place:int>>"


def _mine(threshold: float):
    """Rows (leaf, part, pos, words) in order: each message's place, and then the part's templates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found = None, None

        def flush():
            made = found.templates()
            ids = [[{"part": at[1], "place": k}] for k in range(len(made))]
            return pd.DataFrame({"leaf": at[0], "pos": None, "part": at[1], "place": range(len(made)), "words": made, "members": ids})

        for batch in batches:
            places = []
            for leaf, part, words in zip(batch["leaf"], batch["part"], batch["words"]):
                if (leaf, part) != at:
                    if found:
                        yield flush()
                    at, found = (leaf, part), TemplateList(len(words), threshold)
                places.append(found.add(list(words)))
            yield pd.DataFrame({"leaf": batch["leaf"], "pos": batch["pos"], "part": batch["part"], "place": places, "words": None, "members": None})
        if found:
            yield flush()

    return run


def _merge(threshold: float):
    """Rows (leaf, part, place, words, members) in order: lists of neighbours become one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found, members = None, None, []

        def flush():
            made = found.templates()
            return pd.DataFrame({"leaf": at[0], "pos": None, "part": at[1], "place": range(len(made)), "words": made, "members": members})

        for batch in batches:
            for leaf, part, words, own in zip(batch["leaf"], batch["part"], batch["words"], batch["members"]):
                if (leaf, part // FAN) != at:
                    if found:
                        yield flush()
                    at, found, members = (leaf, part // FAN), TemplateList(len(words), threshold), []
                place = found.add(list(words))
                if place == len(members):
                    members.append([])
                members[place] = [*members[place], *own]
        if found:
            yield flush()

    return run


def merged_templates(rows: DataFrame, config: ParsingConfig, stream: str | None = None, part: int = PART) -> DataFrame:
    """rows with EventTemplate, TemplateId and Parameters, as distinct_templates, but without a task
    that has a whole stream.

    Where templates are told apart by the threshold whatever has been seen, this is what mining in
    order of first appearance gives. Templates are never dropped (max_clusters bounds a tree
    that goes with a stream; here all have their place in a table). A leaf's templates meet in
    one task at last, not its messages. Null Content is left out; rows without stream are
    a stream.
    """
    rows = once(_checked(rows), "_masked", masked(F.col("Content"), config))
    key = F.coalesce(F.concat(F.lit("+"), F.col(stream).cast("string")), F.lit("")) if stream else F.lit("")
    rows = rows.withColumn("_stream", key)
    order = _order(rows)
    first = rows.groupBy(F.col("_stream").alias("stream"), "_masked").agg(F.min(F.struct(*order)).alias("first"))
    messages = leaf_paths(first.withColumn("words", tokens(F.col("_masked"), config)), config)
    placed = numbered(messages.withColumn("leaf", F.to_json(F.struct("stream", "n", "path"))), ["first", "_masked"], "pos", ["leaf"])
    placed = kept(placed.withColumn("part", F.floor(F.col("pos") / part)), "messages")

    parts = placed.select("leaf", "part", "pos", "words").repartition("leaf", "part").sortWithinPartitions("leaf", "part", "pos")
    mined = kept(parts.mapInPandas(_mine(config.similarity_threshold), _LISTS), "mined")
    lists, left = mined.where("pos IS NULL"), (placed.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        near = lists.repartition("leaf", F.floor(F.col("part") / FAN)).sortWithinPartitions("leaf", "part", "place")
        lists, left = kept(near.mapInPandas(_merge(config.similarity_threshold), _LISTS), "lists"), -(-left // FAN)

    ends = lists.select("leaf", F.col("place").alias("final"), F.array_join("words", " ").alias("EventTemplate"), F.explode("members").alias("m"))
    ends = ends.select("leaf", "final", "EventTemplate", F.col("m.part").alias("part"), F.col("m.place").alias("place"))
    known = mined.where("pos IS NOT NULL").select("leaf", "pos", "part", "place").join(ends, ["leaf", "part", "place"])
    known = kept(placed.select("leaf", "pos", "stream", "_masked", "first").join(known.drop("part", "place"), ["leaf", "pos"]), "known")
    opened = known.groupBy("stream", "leaf", "final").agg(F.min(F.struct("first", "_masked")).alias("opened"))
    ids = numbered(opened, ["opened"], "_nth", ["stream"]).select("leaf", "final", (F.col("_nth") + 1).alias("TemplateId"))
    by_message = known.join(ids, ["leaf", "final"]).select(F.col("stream").alias("_stream"), "_masked", "EventTemplate", "TemplateId")
    joined = rows.join(by_message, ["_stream", "_masked"])
    out = joined.withColumn("Parameters", parameters(F.col("Content"), F.col("EventTemplate"), config))
    return out.select(*[c for c in rows.columns if c not in ("_masked", "_stream")], "EventTemplate", "TemplateId", "Parameters")
