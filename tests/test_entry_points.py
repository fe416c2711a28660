import json
import re
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import duckdb
import pytest
from pyspark.sql import functions as F

import stratalog
from stratalog import cli
from stratalog.config import DatasetConfig, ParsingConfig
from stratalog.functions.patterns import match_groups, named_groups
from stratalog.functions.times import parse_time
from stratalog.operators import records, views
from stratalog.operators.templates import parameters
from stratalog.sources import push
from stratalog.sources.readers import load_dataset
from stratalog.sources.writers import shared_folder


def test_exports():
    assert all(getattr(stratalog, n) for n in stratalog.__all__) and "BatchPipeline" in stratalog.__all__
    with pytest.raises(AttributeError):
        stratalog.nothing


@pytest.mark.parametrize("pattern", [r"(?P<a>\w+)(?: (?P<b>\d+))?(x)? (?P<c>.*)", r"(?P<a>.+?)-(?P<b>.*)", r"(?i)(?P<a>q)|(?P<b>r)", "(?x) (?P<a> \\w ) # note"])
def test_groups_as_in_python(spark, pattern):
    texts = ["ab 12 rest", "ab rest", "ab 1x tail\nmore", "", "q", "R", "a-b-c", "﷑-﷑ x", "nothing:", "é 7 $1 \\2"]
    groups = named_groups(F.col("g"), pattern)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("g", match_groups(F.col("t"), pattern))
    got = [tuple(r) for r in rows.orderBy("i").select(F.size("g") > 1, *groups.values()).collect()]
    want = []
    for t in texts:
        m = re.match(pattern, t)
        want.append((bool(m), *((m[n] or None if m[n] in (None, "") and n != "c" else m[n]) if m else None for n in groups)))
    same = lambda a, b: a[0] == b[0] and (not a[0] or all((x or "") == (y or "") for x, y in zip(a[1:], b[1:])))
    assert all(same(a, b) for a, b in zip(got, want)), (got, want)


def test_parameters_of_templates(spark):
    rows = [
        ("user 7 did view", "user <:NUM:> did <*>", ["7", "view"]), ("at 1.2 . 3 end", "at <:IP:> end", ["1.2 . 3"]), ("a_b 1", "a b <:NUM:>", ["1"]),
        ("same words", "same words", []), ("other", "one <*>", []), ("(x) $1 \\E [y]", "(x) <*> \\E [y]", ["$1"]), ("a  b", "a <*>", ["b"]), (None, "a <*>", []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, t string, p array<string>")
    got = df.orderBy("i").select(parameters(F.col("c"), F.col("t"), ParsingConfig()).alias("p")).collect()
    assert [r.p for r in got] == [r[2] for r in rows]


def test_streams_go_by_their_configs(spark):
    names = ["bgl", "hdfs", "hdfs_v1", "Apache"]
    want = {"bgl": "bgl", "HDFS": "hdfs", "hdfs_v": "hdfs_v1", "apa": "Apache", "none": None, "": None}
    for stream, config in want.items():
        if config:
            assert records.config_of_stream(stream, names) == config
        else:
            with pytest.raises(LookupError):
                records.config_of_stream(stream, names)
    got = records.routed_requests(spark.createDataFrame([(s,) for s in [*want, *want]], "datastream string"), names).collect()
    assert len(got) == 12 and {r.datastream: r.config for r in got} == want


def test_configs_as_a_table(spark):
    table = spark.createDataFrame([(n,) for n in ["bgl", "hdfs", "hdfs_v1", "Apache", "", None]], "config string")
    want = {"bgl": "bgl", "HDFS": "hdfs", "hdfs_v": "hdfs_v1", "apa": "Apache", "none": None, "": None}
    got = records.routed_requests(spark.createDataFrame([(s,) for s in [*want, None]], "datastream string"), table).collect()
    assert len(got) == 7 and {r.datastream: r.config for r in got} == want | {None: None}


def test_streams_beyond_the_first_thousand_have_configs(spark, tmp_path):
    from stratalog.plans import queries as Q

    users, c = [None, -3, 0, 9, 10, 99, 100, 999, 1000, 1499, 12345], duckdb.connect()
    rows = [(i, datetime(2024, 1, 1), u, "view", 1.0, "{}") for i, u in enumerate([*users, *users])]
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = c.execute(Q.ORACLES["routed_streams"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in Q.QUERIES["routed_streams"](spark, str(tmp_path)).collect()) and len(want) == len(users)


def test_records_are_pushed(spark):
    taken = []

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):
            taken.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "s", "a <*>", 1, "x"), (datetime(2024, 1, 2), None, None, None, "y")], "Timestamp timestamp_ntz, datastream string, EventTemplate string, TemplateId long, Content string")
    push.push(records.log_records(rows), f"http://127.0.0.1:{server.server_port}/push")
    server.shutdown()
    streams = {s["stream"]["datastream"]: s for body in taken for s in body["streams"]}
    assert streams["s"]["stream"] == {"datastream": "s", "EventTemplate": "a <*>", "TemplateId": "1"} and set(streams) == {"s", "unknown"}
    ts, line, meta = streams["s"]["values"][0]
    assert ts == "1704067200000000000" and json.loads(line)["Content"] == "x" and meta["Content"] == "x"
    push.push(records.log_records(rows), f"http://127.0.0.1:{server.server_port}/gone")  # logged, not raised


def test_bytes_that_are_not_utf8_go(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("kept � é\n".encode() + b"bad \xff\xfe \xef\xbf\xbd end\r\n\n  \nlast")
    got = load_dataset(spark, DatasetConfig(path=f"file://{tmp_path}/a.log")).orderBy("line_no").collect()
    assert [(r.raw_log, r.line_no) for r in got] == [("kept � é", 1), ("bad  � end", 2), ("last", 3)]


@pytest.mark.parametrize("text", ['[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]', '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n'])
def test_json_arrays_and_lines(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert sorted((r.a, r.b) for r in load_dataset(spark, DatasetConfig(path=f"file://{tmp_path}/a.json", format="json")).collect()) == [(1, "x"), (2, None)]


def test_histogram_has_empty_bins(spark):
    got = views.histogram(spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "s double"), "s", 5).orderBy("bin").collect()
    assert [r.n for r in got] == [2, 0, 0, 0, 1] and got[0].mean == pytest.approx(11 / 3) and got[4].high == 10
    assert views.histogram(spark.createDataFrame([], "s double"), "s").count() == 0


def test_inferred_times(spark):
    texts = {"2024-03-04 05:06:07": (3, 4), "2024/03/04 05:06:07": (3, 4), "04-03-2024": (3, 4), "04/03/2024 05:06:07.5": (3, 4), "noon": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_time(F.col("t"), None).alias("at")).collect()
    assert {r.t: r.at and (r.at.month, r.at.day) for r in got} == texts


def test_plot_files(spark, tmp_path):
    rows = [(datetime(2024, 1, 1), 5, 1.0, True), (datetime(2024, 1, 2), 6, 0.5, False)]
    df = spark.createDataFrame(rows, "Window timestamp_ntz, LogCount long, AnomalyScore double, IsAnomaly boolean")
    df.write.parquet(f"file://{tmp_path}/anomalies.parquet")
    assert cli.main(["visualize", f"file://{tmp_path}", "--format", "csv"]) == 0
    assert {p.name for p in (tmp_path / "plots").iterdir()} == {"scores.csv", "histogram.csv", "box.csv", "count_and_score.csv"}


def test_clusters_need_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        shared_folder(Session, "x")


def test_push_tries_again(spark, monkeypatch):
    seen = []

    class Busy(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            seen.append(self.path)
            self.send_response(404 if self.path == "/gone" else 503 if len(seen) < 3 else 204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(push, "FIRST_WAIT", 0.01)
    url = f"http://127.0.0.1:{server.server_port}"
    assert push.send_request(url + "/push", b"{}") is None and len(seen) == 3
    assert push.send_request(url + "/gone", b"{}").code == 404 and len(seen) == 4
    server.shutdown()
    with pytest.raises(Exception, match="404|refused|Connection"):
        rows = records.log_records(spark.createDataFrame([("2024-01-01", "s", "t")], "Timestamp string, datastream string, EventTemplate string").selectExpr("CAST(Timestamp AS TIMESTAMP_NTZ) AS Timestamp", "datastream", "EventTemplate"))
        push.push(rows, "http://127.0.0.1:9/none", must=True)
