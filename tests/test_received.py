"""Received requests: killed receivers, restarted streams, forwarded partitions."""

import json
import os
import signal
import socket
import subprocess
import sys
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from stratalog.operators.records import forwarded
from stratalog.sources import push as P
from stratalog.sources.received import ReceivedRequests, RequestLog, forward, http_receiver, line_receiver

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def source(spark):
    spark.dataSource.register(ReceivedRequests)
    return lambda folder, **k: spark.readStream.format("received_requests").option("path", str(folder)).options(**k).load()


def drain(stream, tmp, out="out"):
    """What a stream that begins where its checkpoint ends has stored so far."""
    q = stream.writeStream.format("parquet").option("path", f"{tmp}/{out}").option("checkpointLocation", f"{tmp}/{out}-state")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{tmp}/{out}")


def free_port():
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


@pytest.fixture
def serving():
    servers = []

    def start(server):
        servers.append(server)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server.server_address[1]

    yield start
    for s in servers:
        s.shutdown()
        s.server_close()


def test_a_log_keeps_whole_requests_and_the_numbers_of_senders(tmp_path):
    log = RequestLog(tmp_path, "r-1", segment_bytes=300)
    for n in range(1, 21):
        assert log.append([{"message": f"m{n}", "datastream": "a", "other": 1}], "s", n)
    assert not log.append([{"message": "again"}], "s", 20) and log.append([{"message": "no sender"}]) and log.append([{"message": "no sender"}])
    log.close()
    last = sorted(tmp_path.glob("*.requests"))[-1]
    with open(last, "ab") as f:
        f.write(b'{"sender": "s", "number": 21, "rows": [{"mess')
    again = RequestLog(tmp_path, "r-1", segment_bytes=300)
    assert not again.append([{}], "s", 20) and again.append([{"message": "m21"}], "s", 21)
    again.close()
    lines = [json.loads(raw) for p in sorted(tmp_path.glob("*.requests")) for raw in p.read_text().splitlines()]
    assert [r["message"] for x in lines for r in x.get("rows", [])] == [*(f"m{n}" for n in range(1, 21)), "no sender", "no sender", "m21"]


def test_a_segment_without_its_first_line(tmp_path):
    log = RequestLog(tmp_path, "r")
    log.append([{"message": "x"}], "s", 7)
    log.close()
    (tmp_path / "r-00000001.requests").write_bytes(b'{"send')
    again = RequestLog(tmp_path, "r")
    assert not again.append([{}], "s", 7) and again.append([{}], "s", 8)
    again.close()


def test_a_stream_reads_ranges_of_segments_once(spark, source, tmp_path):
    logs = [RequestLog(tmp_path / "log", name, segment_bytes=2000) for name in ("a", "b-c")]
    want, n = [], 0
    for _ in range(3):
        for log in logs:
            for _ in range(40):
                n += 1
                rows = [{"message": f"{n}.{k} é\n", "datastream": None if k else log.name} for k in range(n % 4)]
                log.append(rows, "s", n)
                want += [r["message"] for r in rows]
        got = drain(source(tmp_path / "log", taskBytes=150), tmp_path)
        assert sorted(r.message for r in got.collect()) == sorted(want)
    assert got.select("receiver", "position", "part").distinct().count() < len(want) + 1
    assert got.where("datastream IS NULL").count() == sum(not r.endswith(".0 é\n") for r in want)


def test_an_empty_log(spark, source, tmp_path):
    (tmp_path / "log").mkdir()
    RequestLog(tmp_path / "log", "a").close()
    assert drain(source(tmp_path / "log"), tmp_path).count() == 0


def test_posts_and_lines(serving, tmp_path):
    log = RequestLog(tmp_path, "r")
    port, lines = serving(http_receiver(log, "127.0.0.1", 0)), serving(line_receiver(log, "127.0.0.1", 0))

    def post(body, **headers):
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}/", body, headers), timeout=5) as r:
            return json.loads(r.read())["status"]

    name = {"X-Sender": "s", "X-Number": "1"}
    assert [post(b'{"message": "one"}'), post(b'[{"message": "two"}]', **name), post(b'[{"message": "two"}]', **name)] == ["ok", "ok", "repeated"]
    for body in (b"{", b"[1]", b"3"):
        with pytest.raises(urllib.error.HTTPError, match="400"):
            post(body)
    with socket.create_connection(("127.0.0.1", lines)) as s:
        s.sendall(b'{"message": "three", "datastream": 5}\n\nplain text\n')
    for _ in range(100):
        rows = [r for raw in next(tmp_path.glob("*.requests")).read_text().splitlines() for r in json.loads(raw).get("rows", [])]
        if len(rows) == 4:
            break
        time.sleep(0.05)
    assert [(r["message"], r["datastream"]) for r in rows] == [("one", None), ("two", None), ("three", "5"), ("plain text", None)]


def test_killed_receivers_lose_and_repeat_nothing(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FIRST_WAIT", 0.2)
    monkeypatch.setattr(P, "TRIES", 9)
    port, folder = free_port(), tmp_path / "log"
    command = [sys.executable, "-m", "stratalog.cli", "receive", str(folder), "--http", str(port), "--host", "127.0.0.1"]
    done, wrong = threading.Event(), []

    def send():
        for n in range(1, 601):
            body = json.dumps([{"message": f"{n}-{k}"} for k in range(3)]).encode()
            wrong.append(P.send_request(f"http://127.0.0.1:{port}/", body, {"X-Sender": "client", "X-Number": str(n)}))
        done.set()

    threading.Thread(target=send, daemon=True).start()
    kills = 0
    while not done.is_set():
        receiver = subprocess.Popen(command, cwd=ROOT, env=os.environ, stderr=subprocess.DEVNULL)
        while not done.is_set() and len(wrong) < 150 * (kills + 1):
            time.sleep(0.001)
        receiver.send_signal(signal.SIGKILL)
        receiver.wait()
        kills += 1
        if folder.exists():
            drain(source(folder, taskBytes=1000), tmp_path)
    assert wrong == [None] * 600 and kills >= 4
    got = drain(source(folder, taskBytes=1000), tmp_path)
    assert sorted(r.message for r in got.collect()) == sorted(f"{n}-{k}" for n in range(1, 601) for k in range(3))


def test_partitions_forwarded_again_are_taken_once(spark, source, serving, tmp_path):
    log = RequestLog(tmp_path / "log", "r")
    url = f"http://127.0.0.1:{serving(http_receiver(log, '127.0.0.1', 0))}/"
    rows = forwarded(spark.range(5000).selectExpr("concat('line ', id) AS message", "CAST(id % 3 AS STRING) AS datastream"))
    forward(rows, url, "job")
    forward(rows, url, "job")
    got = drain(source(tmp_path / "log"), tmp_path)
    assert got.count() == 5000 and got.select("message").distinct().count() == 5000


def test_refused_requests_fail_their_task(spark, serving):
    class No(BaseHTTPRequestHandler):
        def do_POST(self):
            self.send_error(400)

        def log_message(self, *_):
            pass

    port = serving(ThreadingHTTPServer(("127.0.0.1", 0), No))
    with pytest.raises(Exception, match="HTTP Error 400"):
        forward(forwarded(spark.createDataFrame([("x",)], "message string")), f"http://127.0.0.1:{port}/", "job")
