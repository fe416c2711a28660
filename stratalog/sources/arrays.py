"""JSON documents that are one long array of rows, read by many tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.sources.writers import TIMES, shared_folder

KEYS = ["_file", "_start"]
BLANK = " \t\r\n﻿"
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_SPLIT = "_file string, _start long, _n long, _quotes long, _outside long, _inside long"
#: Rows of states up to which these are broadcast: about 100 bytes each, one for a file split.
MOST_SPLITS = 200_000


def _nesting(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def scan_piece(text: str) -> tuple[int, int, int]:
    """(quotes, depth gained if the piece begins outside a string, depth gained if it begins in
    one). No piece begins behind a backslash: one before } is not JSON."""
    parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
    return len(parts) - 1, sum(map(_nesting, parts[::2])), sum(map(_nesting, parts[1::2]))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, with its file split and its order there. Spark cuts the
    files, as it does between lines."""
    pieces = spark.read.option("lineSep", "}").text(path)
    return pieces.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows of one file split; a split's rows stand together, over several batches."""
    for batch in batches:
        if len(batch):
            change = (batch[KEYS] != batch[KEYS].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(change.to_numpy(), sort=False):
                yield tuple(rows[KEYS].iloc[0]), rows


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each split: its pieces, its quotes, and the depth gained for both ways in which it
    may begin."""
    key, totals = None, [0, 0, 0, 0]

    def row() -> pd.DataFrame:
        return pd.DataFrame([[*key, *totals]], columns=[*KEYS, "_n", "_quotes", "_outside", "_inside"])

    for found, rows in _by_split(batches):
        if found != key:
            if key:
                yield row()
            key, totals = found, [0, 0, 0, 0]
        for text in rows["value"]:
            quotes, even, odd = scan_piece(text + "}")
            if totals[1] % 2:
                even, odd = odd, even
            totals = [totals[0] + 1, totals[1] + quotes, totals[2] + even, totals[3] + odd]
    if key:
        yield row()


def split_states(pieces: DataFrame) -> DataFrame:
    """(_file, _start, _n, _in, _depth, _last): how each split begins, from the sums of those
    before it. One row a split, in a window by file."""
    found = pieces.select(*KEYS, "value").mapInPandas(_summaries, _SPLIT)
    order = Window.partitionBy("_file").orderBy("_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2
    found = found.withColumn("_in", parity == 1).withColumn("_gain", F.when(F.col("_in"), F.col("_inside")).otherwise(F.col("_outside")))
    depth = F.coalesce(F.sum("_gain").over(before), F.lit(0))
    return found.select(*KEYS, "_n", "_in", depth.alias("_depth"), F.lead("_start").over(order).isNull().alias("_last"))


@dataclass
class ElementScan:
    """The pieces of one split, from the state in which it begins: whole elements as they end, and
    the parts of those that other splits begin or end."""

    file: str
    start: int
    left: int
    inside: bool
    depth: int
    last: bool
    held: list[str] = field(default_factory=list)
    begun: bool = False

    def __post_init__(self) -> None:
        self.open = self.inside or self.depth > 1

    def _wrong(self, what: str) -> ValueError:
        return ValueError(f"{self.file}, split at {self.start}: {what}")

    def _begin(self, text: str) -> str | None:
        """text from where its element begins; None behind the array's end."""
        text = text.lstrip(BLANK)
        if self.depth == 0:
            if not text.startswith("["):
                raise self._wrong("no array begins here")
            self.depth, text = 1, text[1:].lstrip(BLANK)
        elif text.startswith(","):
            text = text[1:].lstrip(BLANK)
        if text.startswith("{"):
            self.open = self.begun = True
            return text
        if text.startswith("]") and not text[1:].strip(BLANK) and self.last and self.left == 0:
            self.depth = 0
            return None
        raise self._wrong(f"an element is no object: {text[:40]!r}")

    def _fragment(self) -> tuple[str, str]:
        part = {"file": self.file, "start": self.start, "begun": self.begun, "text": "".join(self.held)}
        return json.dumps(part), "part"

    def add(self, piece: str) -> Iterator[tuple[str, str]]:
        """(value, kind) of what ends with this piece."""
        self.left -= 1
        final = self.last and self.left == 0
        text = piece if final else piece + "}"
        if not self.open:
            text = self._begin(text)
        if text is not None:
            quotes, outside, inside = scan_piece(text)
            self.depth += inside if self.inside else outside
            self.inside ^= quotes % 2 == 1
            self.held.append(text)
            if not self.inside and self.depth == 1:
                yield ("".join(self.held).translate({10: " ", 13: " "}), "whole") if self.begun else self._fragment()
                self.held, self.open, self.begun = [], False, False
        if final and (self.open or self.depth):
            raise self._wrong("the array does not end")
        if self.left == 0 and self.open:
            yield self._fragment()


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, scan = None, None
    for found, rows in _by_split(batches):
        if found != key:
            first = rows.iloc[0]
            key, scan = found, ElementScan(found[0], int(found[1]), int(first["_n"]), bool(first["_in"]), int(first["_depth"]), bool(first["_last"]))
        yield pd.DataFrame([e for text in rows["value"] for e in scan.add(text)], columns=["value", "kind"])


def array_elements(spark: SparkSession, path: str) -> str:
    """A pattern of folders that hold every element of the arrays at path as a line of its own.

    A first pass counts quotes and brackets of each file split for both states in which it may
    begin, inside a string or not; a row a split is summed up; a second pass cuts the elements.
    Only elements that cross splits are shuffled, and their parts joined: no task has more than
    a split and such an element. Compressed files are one split each.
    """
    pieces = _pieces(spark, path)
    table = shared_folder(spark, "array-splits")
    split_states(pieces).write.parquet(table)
    states = spark.read.parquet(table)
    if states.count() <= MOST_SPLITS:
        rows = pieces.join(F.broadcast(states), KEYS)
    else:
        rows = pieces.join(states.hint("merge"), KEYS).sortWithinPartitions(*KEYS, "_id")
    folder = shared_folder(spark, "array")
    found = rows.select(*KEYS, "value", "_n", "_in", "_depth", "_last").mapInPandas(_elements, "value string, kind string")
    found.write.partitionBy("kind").text(folder)
    spark.createDataFrame([], "value string").write.mode("append").text(f"{folder}/kind=part")  # the folder, if nothing was cut
    parts = spark.read.text(f"{folder}/kind=part").select(F.from_json("value", "file string, start long, begun boolean, text string").alias("p")).select("p.*")
    order = Window.partitionBy("file").orderBy("start", "begun").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.col("begun").cast("long")).over(order)
    numbers = parts.select("file", "start", "begun", number.alias("number"))
    whole = (
        parts.join(numbers, ["file", "start", "begun"]).groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("start", "begun", "text"))).alias("parts"))
        .select(F.translate(F.array_join(F.transform("parts", lambda p: p["text"]), ""), "\r\n", "  ").alias("value"))
    )
    whole.write.text(f"{folder}/kind=joined")
    return f"{folder}/kind={{whole,joined}}"


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The rows of files that are JSON arrays of objects, in UTF-8, in no promised order.

    They are written once as lines to the shared folder, where they stay until the caller deletes
    them. An empty array has no rows and no columns. Raises if an element is no object (null
    too), or an array does not begin or end.
    """
    return spark.read.json(array_elements(spark, path))


def _bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    mark = "["
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"value": [mark + batch["value"].iloc[0], *("," + v for v in batch["value"].iloc[1:])]})
            mark = ","
    yield pd.DataFrame({"value": ["[]" if mark == "[" else "]"]})


def write_json_arrays(rows: DataFrame, folder: str) -> None:
    """Write rows as JSON documents that are arrays, one a task; null fields are left out."""
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), TIMES).alias("value"))
    lines.mapInPandas(_bracketed, "value string").write.text(folder)
