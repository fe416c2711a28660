"""Stored records sent to a log store over HTTP, partition by partition."""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

#: Records of a request, seconds that one may take, tries, and seconds before the second.
BATCH, TIMEOUT, TRIES, FIRST_WAIT = 1000, 5.0, 5, 0.5


def request_body(records: Iterable[Row]) -> dict:
    """Streams by label, with (time, line, metadata) entries in order."""
    streams: dict[tuple, list] = {}
    for r in records:
        labels = tuple((k, r[k]) for k in ("datastream", "EventTemplate", "TemplateId") if r[k])
        streams.setdefault(labels, []).append([r["ts_ns"], r["line"], r["meta"] or {}])
    return {"streams": [{"stream": dict(k), "values": v} for k, v in streams.items()]}


def send_request(url: str, body: bytes, headers: dict[str, str] | None = None) -> OSError | None:
    """Post body to url, again after FIRST_WAIT seconds and twice as long each time while the server
    is not reached or not able; what is wrong at last, if anything. Refusals are not tried again."""
    for attempt in range(TRIES):
        try:
            asked = urllib.request.Request(url, body, {"Content-Type": "application/json"} | (headers or {}))
            urllib.request.urlopen(asked, timeout=TIMEOUT).close()
            return None
        except urllib.error.HTTPError as e:
            wrong = e
            if e.code < 500 and e.code != 429:
                return e
        except OSError as e:
            wrong = e
        if attempt + 1 < TRIES:
            time.sleep(FIRST_WAIT * 2**attempt)
    return wrong


def push(records: DataFrame, url: str, must: bool = False) -> None:
    """Send records (as log_records gives them) to url. A request that fails after some tries is
    logged by its task and left out, and the others go on; with must the task fails
    instead, so that Spark runs it again and nothing is lost, while some may be sent twice."""

    def send(rows: Iterator[Row]) -> None:
        while batch := list(islice(rows, BATCH)):
            wrong = send_request(url, json.dumps(request_body(batch)).encode())
            if wrong and must:
                raise wrong
            if wrong:
                logging.getLogger("stratalog").error("%d records were not taken by %s: %s", len(batch), url, wrong)

    records.foreachPartition(send)


def push_stream(records: DataFrame, url: str, checkpoint: str):
    """The same for a stream of records, micro-batch by micro-batch."""
    writer = records.writeStream.foreachBatch(lambda batch, _: push(batch, url))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
