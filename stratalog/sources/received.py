"""Requests that are received over the network, logged before they are answered, and read from the
log as a stream: neither a restart of the receiver nor one of the stream loses or repeats any."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import islice
from pathlib import Path
from socketserver import StreamRequestHandler, ThreadingTCPServer

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from stratalog.sources.push import BATCH, send_request

FIELDS = ("message", "datastream", "timestamp", "original_timestamp")
#: Bytes after which a receiver begins a new segment, and bytes that one task reads at most.
SEGMENT_BYTES, TASK_BYTES = 64 << 20, 16 << 20


def _segments(folder: str) -> dict[str, list[Path]]:
    """The segments of every receiver in a folder, in order."""
    found: dict[str, list[Path]] = {}
    for path in sorted(Path(folder).glob("*.requests")):
        found.setdefault(path.name.rsplit("-", 1)[0], []).append(path)
    return found


def _whole_lines(path: Path, size: int) -> int:
    """How many of the first size bytes end with a line; read from the end, block by block."""
    with open(path, "rb") as f:
        while size > 0:
            begin = max(0, size - (1 << 16))
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


class RequestLog:
    """What one receiver took, in append-only segments below a folder that the stream's tasks see.

    A line is one request: it counts if its line is whole, and is on disk before append returns. A
    segment begins with the last number of every sender, so that a receiver which starts again only
    reads its last one. What was being written when it was killed is cut off: it was never answered.
    """

    def __init__(self, folder: str, name: str, segment_bytes: int = SEGMENT_BYTES):
        self.folder, self.name, self.segment_bytes = Path(folder), name, segment_bytes
        self.last: dict[str, int] = {}
        self.lock = threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)
        mine = _segments(folder).get(name, [])
        self.number = len(mine)
        if not mine:
            self._roll()
            return
        keep = _whole_lines(mine[-1], mine[-1].stat().st_size)
        self.file = open(mine[-1], "r+b")
        for raw in self.file.read(keep).splitlines():
            line = json.loads(raw)
            if "senders" in line:
                self.last = line["senders"]
            elif line["sender"]:
                self.last[line["sender"]] = line["number"]
        self.file.truncate(keep)
        self.file.seek(keep)
        if not keep:
            self._recall(mine[:-1])

    def _recall(self, before: list[Path]) -> None:
        """A segment whose first line was cut off: the numbers are those of the one before."""
        if before:
            for raw in before[-1].read_bytes().splitlines():
                line = json.loads(raw)
                self.last = line["senders"] if "senders" in line else self.last
                if line.get("sender"):
                    self.last[line["sender"]] = line["number"]
        self._write({"senders": self.last})

    def _write(self, line: dict) -> None:
        self.file.write(json.dumps(line).encode() + b"\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def _roll(self) -> None:
        if self.number:
            self.file.close()
        self.file = open(self.folder / f"{self.name}-{self.number:08d}.requests", "xb")
        self.number += 1
        self._write({"senders": self.last})

    def append(self, rows: Iterable[dict], sender: str = "", number: int = 0) -> bool:
        """Store the rows of a request; False if the sender's number was stored before. Senders
        number their requests upwards from 1; those without a name are always stored."""
        with self.lock:
            if sender and number <= self.last.get(sender, 0):
                return False
            if self.file.tell() >= self.segment_bytes:
                self._roll()
            kept = [{k: None if r.get(k) is None else str(r[k]) for k in FIELDS} for r in rows]
            self._write({"sender": sender, "number": number, "rows": kept})
            if sender:
                self.last[sender] = number
            return True

    def close(self) -> None:
        self.file.close()


def http_receiver(log: RequestLog, host: str = "0.0.0.0", port: int = 8080) -> ThreadingHTTPServer:
    """A server that logs posted requests, an object or an array of objects. The headers X-Sender
    and X-Number name a request that may be sent again. It answers 200 when they are on disk, 400
    for what is not JSON. Start it with serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            try:
                rows = json.loads(body)
                rows = rows if isinstance(rows, list) else [rows]
                if not all(isinstance(r, dict) for r in rows):
                    raise ValueError("requests are objects")
                number = int(self.headers.get("X-Number", 0))
            except ValueError as e:
                self._answer(400, {"status": "error", "reason": str(e)})
                return
            new = log.append(rows, self.headers.get("X-Sender", ""), number)
            self._answer(200, {"status": "ok" if new else "repeated", "requests": len(rows)})

        def _answer(self, code: int, answer: dict) -> None:
            body = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def line_receiver(log: RequestLog, host: str = "0.0.0.0", port: int = 9000) -> ThreadingTCPServer:
    """A server that logs JSON lines as they come; lines that are no JSON objects are kept as
    messages. Lines have no answer, so a sender cannot know which ones a killed receiver took."""

    class Handler(StreamRequestHandler):
        def handle(self) -> None:
            for raw in self.rfile:
                text = raw.decode("utf-8", "ignore").strip()
                try:
                    row = json.loads(text)
                except ValueError:
                    row = text
                if text:
                    log.append([row if isinstance(row, dict) else {"message": text}])

    ThreadingTCPServer.allow_reuse_address = True
    return ThreadingTCPServer((host, port), Handler)


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _LogReader(DataSourceStreamReader):
    """Offsets are {receiver: [segment, bytes]}: what lies before them never changes."""

    def __init__(self, folder: str, task_bytes: int):
        self.folder, self.task_bytes = folder, task_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for name, paths in _segments(self.folder).items():
            found[name] = [len(paths) - 1, _whole_lines(paths[-1], paths[-1].stat().st_size)]
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        segments, out = _segments(self.folder), []
        for name, (last, stop) in sorted(end.items()):
            first, at = start.get(name, (0, 0))
            for k in range(first, last + 1):
                path = segments[name][k]
                begin, until = at if k == first else 0, stop if k == last else path.stat().st_size
                out += [_Range(str(path), b, min(b + self.task_bytes, until)) for b in range(begin, until, self.task_bytes)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        """The requests whose lines begin in the range. A line begins where the one before it ends."""
        name = Path(part.path).name.rsplit("-", 1)[0]
        with open(part.path, "rb") as f:
            f.seek(max(0, part.begin - 1))
            if part.begin:
                f.readline()
            while (at := f.tell()) < part.end and (raw := f.readline()):
                for k, row in enumerate(json.loads(raw).get("rows", [])):
                    yield (*[row[c] for c in FIELDS], name, at, k)


class ReceivedRequests(DataSource):
    """Options: path (a folder that driver and executors have mounted), taskBytes. Rows: message, datastream,
    timestamp, original_timestamp, receiver, position and part (where the log has them)."""

    @classmethod
    def name(cls) -> str:
        return "received_requests"

    def schema(self) -> str:
        return "message string, datastream string, timestamp string, original_timestamp string, receiver string, position long, part int"

    def streamReader(self, schema) -> DataSourceStreamReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return _LogReader(options["path"], int(options.get("taskbytes", TASK_BYTES)))


def forward(requests: DataFrame, url: str, job: str) -> None:
    """Post requests (as operators.records.forwarded gives them) to an http_receiver, partition by partition.

    A request is tried again, and at last fails its task, which Spark runs again. job names the run: a partition's requests
    are numbered, so what was taken before is not taken twice, as long as the partition
    gets the same rows in the same order again (read from files, or sorted within partitions).
    """

    def send(rows: Iterator[Row]) -> None:
        sender, number = f"{job}-{TaskContext.get().partitionId()}", 0
        while batch := list(islice(rows, BATCH)):
            number += 1
            body = json.dumps([r.asDict() for r in batch]).encode()
            wrong = send_request(url, body, {"X-Sender": sender, "X-Number": str(number)})
            if wrong:
                raise wrong

    requests.foreachPartition(send)
