"""Stored lines as a stream that keeps their pace: a Spark data source named "log_replay"."""

from __future__ import annotations

import json
import re
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def replay_time(event: datetime, base: datetime, wall_start: datetime, speed: float) -> datetime:
    """When an event is due that happened so long after base, at speed times its pace."""
    return wall_start + (event - base) / speed


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.stream = options["path"], options.get("datastream", "unknown")
        pattern, self.format = options.get("timestampregex"), options.get("timestampformat")
        self.pattern = re.compile(pattern) if pattern else None
        self.speed, self.rows = float(options.get("speed", "1")), int(options.get("rowsperbatch", "1000"))
        self.wall = options.get("wallstart")

    def initialOffset(self) -> dict:
        return {"byte": 0, "base": None, "wall": self.wall or datetime.now(UTC).replace(tzinfo=None).isoformat()}

    def _event(self, line: str) -> datetime | None:
        m = self.pattern.search(line) if self.pattern and self.format else None
        if not m:
            return None
        try:
            return datetime.strptime(m.groupdict().get("ts") or m.group(1), self.format)
        except (ValueError, IndexError):
            return None

    def _rows(self, start: dict, limit: int, until: int | None, due_only: bool):
        base = datetime.fromisoformat(start["base"]) if start["base"] else None
        wall, out, at = datetime.fromisoformat(start["wall"]), [], start["byte"]
        now = datetime.now(UTC).replace(tzinfo=None)
        with open(self.path, "rb") as f:
            f.seek(at)
            while len(out) < limit and (until is None or at < until):
                raw = f.readline()
                if not raw:
                    break
                line = raw.decode("utf-8", "ignore").strip()
                event = self._event(line) if line else None
                base = base or event
                due = replay_time(event, base, wall, self.speed) if event and self.speed > 0 else now
                if due_only and due > now + timedelta(milliseconds=1):
                    break
                at += len(raw)
                if line:
                    out.append((line, self.stream, due.isoformat(), event.isoformat() if event else None))
        return out, {"byte": at, "base": base.isoformat() if base else None, "wall": start["wall"]}

    def read(self, start: dict):
        rows, end = self._rows(start, self.rows, None, due_only=True)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start, 1 << 62, end["byte"], due_only=False)[0])


class LogReplay(DataSource):
    """Options: path, datastream, timestampRegex (group ts or 1), timestampFormat, speed (0:
    unpaced), rowsPerBatch, wallStart. Rows: message, datastream, timestamp (of the replay),
    original_timestamp. One reader reads one file, as one sender does."""

    @classmethod
    def name(cls) -> str:
        return "log_replay"

    def schema(self) -> str:
        return "message string, datastream string, timestamp string, original_timestamp string"

    def simpleStreamReader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def send_lines(rows, connect, retries: int = 5, backoff: float = 1.0, sleep=time.sleep) -> None:
    """Send ingest requests as JSON lines over what connect() opens, with doubled waits
    between tries."""
    for attempt in range(retries):
        try:
            sock = connect()
            break
        except OSError:
            if attempt == retries - 1:
                raise
            sleep(backoff * 2**attempt)
    with sock:
        for row in rows:
            sock.sendall(json.dumps({k: v for k, v in row.items() if v is not None}).encode() + b"\n")
