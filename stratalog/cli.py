"""Command line: run a config, print the plot data of a run's results, or receive requests."""

from __future__ import annotations

import argparse
import json
import logging
import threading
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalog.config import load_config
from stratalog.operators.views import box_by_class, count_and_score, histogram, score_series
from stratalog.plans.pipeline import BatchPipeline
from stratalog.sources.readers import read_results
from stratalog.sources.received import RequestLog, http_receiver, line_receiver
from stratalog.sources.writers import write_stage


def setup_logging(level: str = "INFO", log_file: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if log_file:
        handlers.append(RotatingFileHandler(log_file, maxBytes=10_000_000, backupCount=7))
    logging.basicConfig(level=level, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)


def _session() -> SparkSession:
    return SparkSession.builder.appName("stratalog").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def receive(folder: str, name: str, host: str, http: int | None, lines: int | None) -> None:
    """Log requests until stopped."""
    log = RequestLog(folder, name)
    servers = [make(log, host, port) for make, port in ((http_receiver, http), (line_receiver, lines)) if port]
    if not servers:
        raise ValueError("give --http or --lines")
    threads = [threading.Thread(target=s.serve_forever) for s in servers]
    for t in threads:
        t.start()
    logging.getLogger("stratalog").info("%s takes requests", name)
    for t in threads:
        t.join()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratalog")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("config")
    run.add_argument("--data-path")
    run.add_argument("--output-dir")
    run.add_argument("-v", "--verbose", action="store_true")
    show = commands.add_parser("visualize")
    show.add_argument("results")
    show.add_argument("--format", choices=("table", "csv", "json", "parquet"), default="table", help="files go to RESULTS/plots")
    show.add_argument("--interactive", action="store_true", help="whole tables instead of their first rows")
    take = commands.add_parser("receive", help="log requests below FOLDER, from where the received_requests source reads them")
    take.add_argument("folder")
    take.add_argument("--name", default="receiver", help="one running process a name")
    take.add_argument("--host", default="0.0.0.0")
    take.add_argument("--http", type=int, help="port of posted JSON")
    take.add_argument("--lines", type=int, help="port of JSON lines over TCP")
    args = parser.parse_args(argv)
    setup_logging("DEBUG" if getattr(args, "verbose", False) else "INFO")
    try:
        if args.command == "run":
            config = load_config(args.config)
            config.dataset.path = args.data_path or config.dataset.path
            config.output.directory = args.output_dir or config.output.directory
            _, summary = BatchPipeline(_session(), config).run()
            print(json.dumps(summary, indent=2, default=str))
        elif args.command == "receive":
            receive(args.folder, args.name, args.host, args.http, args.lines)
        else:
            anomalies = read_results(_session(), args.results).withColumn("IsAnomaly", F.col("IsAnomaly").cast("boolean"))
            plots = {"scores": score_series(anomalies), "histogram": histogram(anomalies, "AnomalyScore"), "box": box_by_class(anomalies)}
            if "LogCount" in anomalies.columns:
                plots["count_and_score"] = count_and_score(anomalies)
            for title, data in plots.items():
                if args.format != "table":
                    print(write_stage(data, f"{args.results}/plots", title, args.format, "overwrite"))
                    continue
                print(title)
                data.show(data.count() if args.interactive else 50, truncate=False)
    except Exception:
        logging.getLogger("stratalog").exception("failed")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
