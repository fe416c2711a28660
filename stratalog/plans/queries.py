"""The registered queries over the supplied tables, and their DuckDB oracles.

`events` is the log: ts is the time, event_type the template, user_id the stream. Lines are
made up from it where a query parses text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.config import AnomalyConfig, DatasetConfig, OutputConfig, ParsingConfig, PipelineConfig, PreprocessingConfig, WindowingConfig
from stratalog.functions.times import parse_time
from stratalog.operators import evaluate, matrix, mining, profile, records, scoring, templates, views, windows
from stratalog.operators.preprocess import parse_lines
from stratalog.plans.pipeline import BatchPipeline, compare_strategies, summarise
from stratalog.sources.arrays import write_json_arrays
from stratalog.sources.readers import load_dataset, read_results
from stratalog.sources.writers import save_stages, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table under the log's names."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("Timestamp"), F.col("event_type").alias("EventTemplate"), F.col("user_id").alias("datastream"),
        F.col("event_id").alias("line_no"), "value", "props",
    )


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored records; the template's number is its rank by name."""
    e = table(spark, sf_dir, "events")
    number = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type"))
    return e.select(
        "ts", F.col("user_id").cast("string").alias("datastream"), F.col("event_type").alias("EventTemplate"),
        number.cast("string").alias("TemplateId"), "event_id",
    )


_RECORDS = """(SELECT ts, CAST(user_id AS VARCHAR) AS datastream, event_type AS "EventTemplate", CAST(list_position(
['click','error','purchase','signup','view'], event_type) AS VARCHAR) AS "TemplateId", event_id FROM events)"""

PATTERN = r"\[(?P<Timestamp>.+?)\]\s+\[(?P<LogLevel>\w+)\]\s+(?P<Content>.+)"
CLOCK = datetime(2024, 2, 1)


def synthetic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event; every eleventh is broken."""
    e = table(spark, sf_dir, "events")
    good = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.when(F.col("event_type") == "error", "error").otherwise("info"),
        F.lit("] user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"), F.lit(" no "), F.col("event_id").cast("string"),
    )
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(good)
    return e.select(raw.alias("raw_log"), F.col("event_id").alias("line_no"))


_LINES = """(SELECT event_id AS line_no, CASE WHEN event_id % 11 = 0 THEN 'broken ' || event_id ELSE '[' || strftime(ts,
'%Y-%m-%d %H:%M:%S') || '] [' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || '] user ' || user_id ||
' did ' || event_type || ' no ' || event_id END AS raw_log FROM events)"""
_RE = r"^\[(.+?)\]\s+\[(\w+)\]\s+(.+)"


def _lenient() -> PreprocessingConfig:
    return PreprocessingConfig(PATTERN, "%Y-%m-%d %H:%M:%S", strict_mode=False)


def _strict() -> PreprocessingConfig:
    return PreprocessingConfig(PATTERN, "%Y-%m-%d %H:%M:%S", strict_mode=True)


MASKS = ParsingConfig(masking_rules=[{"regex_pattern": r"(\d+)", "mask_with": "NUM"}])


@query("""
PIVOT (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "Window", event_type FROM events)
ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*) GROUP BY "Window"
""")
def fixed_window_matrix(spark, sf_dir):
    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    names = ["click", "error", "purchase", "signup", "view"]
    return counts.groupBy("Window").pivot("EventTemplate", names).agg(F.sum("cnt")).na.fill(0)


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "Window", min(ts) AS "WindowStart", max(ts) AS "WindowEnd", count(*) AS "LogCount",
       string_agg(event_type, ',' ORDER BY ts, event_id) AS templates
FROM events GROUP BY 1
""")
def fixed_window_stats(spark, sf_dir):
    found = windows.window_table(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return found.select("Window", "WindowStart", "WindowEnd", "LogCount", F.array_join("EventTemplates", ",").alias("templates"))


@query("""
WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
w AS (SELECT lo + INTERVAL 2 HOUR * k AS s FROM b, generate_series(0, CAST(date_diff('hour', lo, hi) AS BIGINT) // 2 + 1) g(k))
SELECT s AS "Window", s AS "WindowStart", s + INTERVAL 6 HOUR AS "WindowEnd", event_type AS "EventTemplate", count(*) AS cnt
FROM w JOIN events ON ts >= s AND ts < s + INTERVAL 6 HOUR GROUP BY ALL
""")
def sliding_window_counts(spark, sf_dir):
    rows = windows.sliding_windows(events(spark, sf_dir), "6h", "2h")
    return rows.groupBy("Window", F.col("_start").alias("WindowStart"), F.col("_end").alias("WindowEnd"), "EventTemplate").agg(
        F.count("*").alias("cnt")
    )


_SESSIONS = """
WITH g AS (SELECT *, date_part('epoch', ts) - date_part('epoch', lag(ts) OVER w) AS gap FROM events WINDOW w AS ({over})),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR trunc(gap) > {timeout} THEN 1 ELSE 0 END) OVER ({over}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT {key} CAST(sid AS BIGINT) AS "SessionId", min(ts) AS "WindowStart", max(ts) AS "WindowEnd", count(*) AS "LogCount"
FROM s GROUP BY ALL
"""


@query(_SESSIONS.format(over="PARTITION BY user_id ORDER BY ts, event_id", timeout=86400, key='user_id AS datastream,'))
def session_windows_by_user(spark, sf_dir):
    rows = windows.session_windows(events(spark, sf_dir), "1d", "datastream")
    return rows.groupBy("datastream", "SessionId").agg(
        F.min("Timestamp").alias("WindowStart"), F.max("Timestamp").alias("WindowEnd"), F.count("*").alias("LogCount")
    )


@query(_SESSIONS.format(over="ORDER BY ts, event_id", timeout=600, key=""))
def session_windows_global(spark, sf_dir):
    found = windows.window_table(windows.session_windows(events(spark, sf_dir), "10m"))
    return found.select("SessionId", "WindowStart", "WindowEnd", "LogCount")


@query("""
WITH RECURSIVE r AS (SELECT epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
nx AS (SELECT i, us, n, lead(us, 99) OVER (ORDER BY i) AS t, max(us) OVER () AS last,
  count(*) OVER (ORDER BY us RANGE BETWEEN 0 PRECEDING AND 21600000000 FOLLOWING) AS cmin,
  count(*) OVER (ORDER BY us RANGE BETWEEN 0 PRECEDING AND 32400000000 FOLLOWING) AS cmax FROM r),
st AS (SELECT i, us, CASE WHEN coalesce(t, last) - us < 21600000000 AND i + 100 < n THEN cmin
  WHEN coalesce(t, last) - us > 32400000000 THEN cmax ELSE least(100, n - i) END AS k FROM nx),
ch AS (SELECT i, us, k FROM st WHERE i = 0 UNION ALL SELECT st.i, st.us, st.k FROM ch JOIN st ON st.i = ch.i + ch.k)
SELECT make_timestamp(us) AS "Window", k AS "LogCount" FROM ch
""")
def adaptive_windows(spark, sf_dir):
    found = windows.window_table(windows.adaptive_windows(events(spark, sf_dir), 100, "6h", "9h"))
    return found.select("Window", "LogCount")


@query(f"""
SELECT line_no, regexp_extract(raw_log, '{_RE}', 2) AS "LogLevel", regexp_extract(raw_log, '{_RE}', 3) AS "Content",
  strptime(regexp_extract(raw_log, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') AS "Timestamp"
FROM {_LINES} WHERE regexp_matches(raw_log, '{_RE}')
""")
def parse_strict(spark, sf_dir):
    return parse_lines(synthetic_lines(spark, sf_dir), _strict()).select("line_no", "LogLevel", "Content", "Timestamp")


@query(f"""
SELECT line_no, CASE WHEN hit THEN regexp_extract(raw_log, '{_RE}', 2) ELSE 'UNKNOWN' END AS "LogLevel",
  CASE WHEN hit THEN regexp_extract(raw_log, '{_RE}', 3) ELSE raw_log END AS "Content",
  CASE WHEN hit THEN strptime(regexp_extract(raw_log, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') ELSE TIMESTAMP '2024-02-01' END AS "Timestamp"
FROM (SELECT *, regexp_matches(raw_log, '{_RE}') AS hit FROM {_LINES})
""")
def parse_lenient(spark, sf_dir):
    rows = parse_lines(synthetic_lines(spark, sf_dir), _lenient(), CLOCK)
    return rows.select("line_no", "LogLevel", "Content", "Timestamp")


@query(f"""
WITH p AS (SELECT line_no, regexp_extract(raw_log, '{_RE}', 3) AS c, strptime(regexp_extract(raw_log, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') AS ts
  FROM {_LINES} WHERE regexp_matches(raw_log, '{_RE}')),
t AS (SELECT *, regexp_replace(c, '(\\d+)', '<:NUM:>', 'g') AS tpl FROM p),
f AS (SELECT tpl, count(*) AS n, min((ts, line_no)) AS first FROM t GROUP BY tpl)
SELECT tpl AS "EventTemplate", row_number() OVER (ORDER BY first, tpl) AS "TemplateId", n FROM f
""")
def mask_and_template_counts(spark, sf_dir):
    rows = templates.masked_templates(parse_lines(synthetic_lines(spark, sf_dir), _strict()), MASKS)
    return rows.groupBy("EventTemplate", "TemplateId").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(replace(replace(text, '_', ' '), ':', ' '), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), ' ') AS words FROM documents
""")
def message_tokens(spark, sf_dir):
    words = templates.tokens(F.col("text"), ParsingConfig(extra_delimiters=["_", ":"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@query("""
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS "Window", event_type AS "EventTemplate", count(*) AS cnt FROM events GROUP BY ALL
""")
def matrix_long(spark, sf_dir):
    return matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "6h"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS "Window", min(ts) AS "WindowStart", max(ts) AS "WindowEnd", count(*) AS "LogCount"
  FROM events GROUP BY 1),
p AS (PIVOT (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS "Window", event_type FROM events)
  ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*) GROUP BY "Window")
SELECT * FROM p LEFT JOIN w USING ("Window")
""")
def matrix_with_metadata(spark, sf_dir):
    assigned = windows.fixed_windows(events(spark, sf_dir), "6h")
    table_ = windows.window_table(assigned)
    return matrix.wide_matrix(matrix.event_counts(assigned), matrix.window_metadata(table_))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS d, avg(value) AS v FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM events) AS total_logs, (SELECT count(DISTINCT event_type) FROM events) AS unique_templates,
  count(*) AS total_windows, CAST(sum(CASE WHEN v > 50 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous_windows,
  round(avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END), 9) AS anomaly_rate FROM w
""")
def run_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    daily = windows.fixed_windows(e, "1d").groupBy("Window").agg((F.avg("value") > 50).alias("IsAnomaly"))
    found = summarise({"templates": e.withColumn("TemplateId", F.col("EventTemplate")), "anomalies": daily})
    return found.withColumn("anomaly_rate", F.round("anomaly_rate", 9))


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS "Window", bool_or(event_type = 'error') AS "HasAlert" FROM events GROUP BY 1""")
def ground_truth_windows(spark, sf_dir):
    return evaluate.ground_truth(windows.fixed_windows(events(spark, sf_dir), "10m"), F.col("EventTemplate") == "error")


@query("""
WITH a AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS "Window", round(max(value), 6) AS "AnomalyScore" FROM events GROUP BY 1),
g AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS "Window", bool_or(event_type = 'error') AS "HasAlert" FROM events
  WHERE event_type IN ('error', 'purchase') GROUP BY 1)
SELECT a."Window", "AnomalyScore", "AnomalyScore" > 90 AS "IsAnomaly", "HasAlert" FROM a JOIN g USING ("Window")
""")
def evaluation_join(spark, sf_dir):
    """Truth is known of windows with an error or a purchase; others have none and go."""
    e = windows.fixed_windows(events(spark, sf_dir), "10m")
    a = e.groupBy("Window").agg(F.round(F.max("value"), 6).alias("AnomalyScore"))
    a = a.withColumn("IsAnomaly", F.col("AnomalyScore") > 90)
    truth = evaluate.ground_truth(e.where("EventTemplate IN ('error', 'purchase')"), F.col("EventTemplate") == "error")
    return evaluate.evaluation_rows(a, e.select("Window").distinct(), truth)


_PRF = """
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp,
  count(*) FILTER (toxic = 1 AND quality = 0) AS fn, count(*) AS n FROM labels)
SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, round((tp + fn) / n, 9) AS positive_rate FROM c
"""


@query(_PRF)
def precision_recall_f1(spark, sf_dir):
    found = evaluate.precision_recall_f1(table(spark, sf_dir, "labels"), "toxic", "quality")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


_CURVE = """
WITH e AS (SELECT event_type = 'error' AS t, round(value, 1) AS s FROM events),
a AS (SELECT s, count(*) FILTER (t) AS tp, count(*) AS n FROM e GROUP BY s),
r AS (SELECT s, sum(tp) OVER w AS tp, sum(n) OVER w AS n, (SELECT count(*) FILTER (t) FROM e) AS total FROM a
  WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT s AS threshold, tp / n AS precision, tp / total AS recall FROM r)
"""


def _scored_events(spark, sf_dir):
    return events(spark, sf_dir).select((F.col("EventTemplate") == "error").alias("t"), F.round("value", 1).alias("s"))


@query(_CURVE + "SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM c")
def pr_curve(spark, sf_dir):
    c = evaluate.precision_recall_curve(_scored_events(spark, sf_dir), "t", "s")
    return c.select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(_CURVE + """SELECT round(sum((recall - coalesce(r0, 0)) * (precision + coalesce(p0, 1)) / 2), 6) AS pr_auc FROM (
  SELECT *, lag(recall) OVER (ORDER BY threshold DESC) AS r0, lag(precision) OVER (ORDER BY threshold DESC) AS p0 FROM c)""")
def pr_auc(spark, sf_dir):
    return evaluate.pr_auc(_scored_events(spark, sf_dir), "t", "s").select(F.round("pr_auc", 6).alias("pr_auc"))


@query("""
SELECT "Window", "AnomalyScore" FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "Window", round(max(value), 6) AS "AnomalyScore" FROM events GROUP BY 1)
WHERE "AnomalyScore" > 50 ORDER BY "AnomalyScore" DESC, "Window" LIMIT 5
""")
def top5_windows(spark, sf_dir):
    e = windows.fixed_windows(events(spark, sf_dir), "1h").groupBy("Window").agg(F.round(F.max("value"), 6).alias("AnomalyScore"))
    return views.top_anomalies(e.withColumn("IsAnomaly", F.col("AnomalyScore") > 50)).select("Window", "AnomalyScore")


@query(f"""SELECT datastream, "TemplateId", count(*) AS n FROM {_RECORDS} GROUP BY ALL ORDER BY n DESC, datastream, "TemplateId" LIMIT 5""")
def topk_templates(spark, sf_dir):
    return views.top_templates(stored_records(spark, sf_dir))


@query(f"""
SELECT step_start, datastream, "TemplateId", n FROM (SELECT *, row_number() OVER (PARTITION BY step_start ORDER BY n DESC, datastream, "TemplateId") AS r
  FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS step_start, datastream, "TemplateId", count(*) AS n FROM {_RECORDS} GROUP BY ALL)) WHERE r <= 5
""")
def topk_templates_by_step(spark, sf_dir):
    return views.top_templates_by_step(stored_records(spark, sf_dir), "1 day")


@query(f"SELECT * FROM {_RECORDS} ORDER BY ts DESC, event_id DESC LIMIT 50")
def live_tail(spark, sf_dir):
    return views.live_tail(stored_records(spark, sf_dir), 50, "event_id")


@query(f"""
SELECT * FROM {_RECORDS} WHERE regexp_full_match(datastream, '1[0-9]*') AND regexp_full_match("EventTemplate", 'e.*|view')
AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
""")
def stream_selector(spark, sf_dir):
    return views.select_stream(stored_records(spark, sf_dir), "1[0-9]*", "e.*|view", "2024-01-05", "2024-01-20")


@query(f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS step_start, "EventTemplate", count(*) AS n FROM {_RECORDS} GROUP BY ALL""")
def volume_by_template(spark, sf_dir):
    return views.volume_by_template(stored_records(spark, sf_dir), "5 minutes")


@query(f"SELECT datastream, count(*) AS n FROM {_RECORDS} GROUP BY 1")
def count_by_stream(spark, sf_dir):
    return views.count_by(stored_records(spark, sf_dir), "datastream")


@query(f"""SELECT datastream, "TemplateId", "EventTemplate", count(*) AS "Count" FROM {_RECORDS} GROUP BY ALL""")
def template_mapping(spark, sf_dir):
    return views.template_mapping(stored_records(spark, sf_dir))


@query(f"SELECT DISTINCT datastream AS value FROM {_RECORDS}")
def label_values(spark, sf_dir):
    return views.label_values(stored_records(spark, sf_dir), "datastream")


_FEATURES = """f AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "Window", event_type AS feature, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL),
n AS (SELECT count(DISTINCT "Window") AS n FROM f)"""


def _features(spark, sf_dir):
    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return counts.select("Window", F.col("EventTemplate").alias("feature"), F.col("cnt").cast("double").alias("value"))


@query(f"""
WITH {_FEATURES}
SELECT feature AS "EventTemplate", round((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1), 6) AS variance
FROM f, n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15
""")
def feature_variance_top15(spark, sf_dir):
    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return views.feature_variances(counts).withColumn("variance", F.round("variance", 6))


@query(f"""
WITH {_FEATURES}, d AS (SELECT feature, count(*) AS df FROM f GROUP BY 1),
r AS (SELECT "Window", feature, value * (ln((1 + n) / (1 + df)) + 1) AS v FROM f JOIN d USING (feature), n)
SELECT "Window", feature, round(v / sqrt(sum(v * v) OVER (PARTITION BY "Window")), 6) AS value FROM r
""")
def tfidf_features(spark, sf_dir):
    return scoring.tfidf(_features(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""
WITH {_FEATURES}, m AS (SELECT feature, sum(value) / any_value(n) AS mean, sqrt(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2) AS sd FROM f, n GROUP BY 1)
SELECT "Window", feature, round((value - mean) / sd, 6) AS value FROM f JOIN m USING (feature)
""")
def standardised_features(spark, sf_dir):
    return scoring.standardised(_features(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("""
WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
h AS (SELECT least(floor((value - lo) / w), 29) AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, (SELECT round(avg(value), 6) FROM events) AS mean FROM range(30) r(k) LEFT JOIN h ON bin = k
""")
def score_histogram(spark, sf_dir):
    return views.histogram(events(spark, sf_dir), "value").select("bin", "n", F.round("mean", 6).alias("mean"))


@query("""
SELECT event_type = 'error' AS "IsAnomaly", round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS most FROM events GROUP BY 1
""")
def box_by_class(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("EventTemplate") == "error").alias("IsAnomaly"), F.col("value").alias("AnomalyScore"))
    found = views.box_by_class(e)
    return found.select("IsAnomaly", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("""
SELECT count(*) AS n_rows, 3 AS n_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_duplicates,
  CAST(count(*) FILTER (text IS NULL) AS BIGINT) AS null_text FROM documents
""")
def quality_profile(spark, sf_dir):
    found = profile.quality_profile(table(spark, sf_dir, "documents").select("text", "lang", "source"))
    return found.select("n_rows", "n_columns", "n_duplicates", F.col("null_counts")["text"].alias("null_text"))


@query(r"""
SELECT doc_id, substring(trim(regexp_replace(replace(replace(text, '\', ' '), '"', ''''), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 250) AS label FROM documents
""")
def record_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.label_value(F.col("text")).alias("label"))


@query("""
SELECT event_id, CAST(epoch_ns(ts) AS VARCHAR) AS ts_ns, CAST(user_id AS VARCHAR) AS datastream, event_type AS "EventTemplate",
  CAST(round(value, 2) AS VARCHAR) AS value FROM events
""")
def record_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("ts").alias("Timestamp"), F.col("user_id").alias("datastream"), F.col("event_type").alias("EventTemplate"), "event_id", F.round("value", 2).alias("value")
    )
    r = records.log_records(e)
    return r.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "ts_ns", "datastream", "EventTemplate", F.col("meta")["value"].alias("value"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "Window", '[' || string_agg('''' || event_type || '''', ',' ORDER BY ts, event_id) || ']' AS "EventTemplates"
FROM events GROUP BY 1
""")
def list_encoding(spark, sf_dir):
    found = windows.window_table(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return records.flat_for_csv(found.select("Window", "EventTemplates"))


@query("""
SELECT 'event ' || event_id AS message, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS datastream,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events
""")
def forwarded_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return records.forwarded(e.select(
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("datastream"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit("x").alias("original_timestamp"),
    ))


@query(f"""
SELECT CASE WHEN NOT regexp_matches(raw_log, '{_RE}') THEN 'skipped' WHEN raw_log LIKE '% did view %' THEN 'no_template' ELSE 'ok' END AS status,
  count(*) AS n FROM {_LINES} GROUP BY 1
""")
def ingest_statuses(spark, sf_dir):
    """Views have no template here."""
    lines = synthetic_lines(spark, sf_dir)
    rows = parse_lines(lines, _strict()).select("line_no", F.when(~F.contains("Content", F.lit(" did view ")), F.col("Content")).alias("template"))
    joined = lines.join(rows.withColumn("parsed", F.lit(True)), "line_no", "left")
    status = records.ingest_status(F.coalesce("parsed", F.lit(False)), F.col("template"))
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _pca_sql(source: str, columns: str = "") -> str:
    """The scores of hourly counts where four of five standardised axes are kept: the fifth is
    found by iteration with trace - covariance, and its variance gives the limit (of level
    0.001, whose normal quantile is written out)."""
    return f"""
WITH RECURSIVE ev AS ({source}),
m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n, {", ".join(f"CAST(count(*) FILTER (t = '{t}') AS DOUBLE) AS x{i}" for i, t in enumerate(_TYPES))} FROM ev GROUP BY 1),
z AS (SELECT w, n, [{", ".join(f"(x{i} - avg(x{i}) OVER ()) / stddev_pop(x{i}) OVER ()" for i in range(5))}] AS z FROM m),
c AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, sum(z[i] * z[j]) / (count(*) - 1) AS v
  FROM z, range(1, 6) a(i), range(1, 6) b(j) GROUP BY i, j) GROUP BY i)),
p AS (SELECT 0 AS k, [1.0, 0.7, -0.4, 0.3, -0.9]::DOUBLE[] AS v UNION ALL
  SELECT k + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (SELECT k, list_transform([1, 2, 3, 4, 5],
    lambda i: 6 * v[i] - list_dot_product(c[i], v)) AS u FROM p, c WHERE k < 20000)),
e AS (SELECT v, list_dot_product(v, list_transform([1, 2, 3, 4, 5], lambda i: list_dot_product(c[i], v))) AS l FROM p, c WHERE k = 20000)
SELECT w AS "Window", {columns} round(list_dot_product(z, v) ** 2, 5) AS "AnomalyScore",
  list_dot_product(z, v) ** 2 > l * (1 + 3.090232306167813 * sqrt(2) / 3 - 2 / 9) ** 3 AS "IsAnomaly" FROM z, e
"""


_TYPES = ("click", "error", "purchase", "signup", "view")
#: Four of five axes explain more than this share of the variance of independent counts, three
#: do not.
_FOUR_OF_FIVE = AnomalyConfig(variance_threshold=0.72)


@query("""SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) AS "Window", 0.0::DOUBLE AS "AnomalyScore", false AS "IsAnomaly" FROM events""")
def pca_anomalies(spark, sf_dir):
    """Where all axes are kept nothing is left over, and the limit is infinite."""
    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return scoring.detect(counts, AnomalyConfig()).withColumn("AnomalyScore", F.round("AnomalyScore", 6))


@query(_pca_sql("SELECT ts, event_type AS t FROM events"))
def pca_scores(spark, sf_dir):
    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return scoring.detect(counts, _FOUR_OF_FIVE).withColumn("AnomalyScore", F.round("AnomalyScore", 5))


_MINED = f"""
p AS (SELECT line_no, regexp_extract(raw_log, '{_RE}', 2) AS level, split_part(regexp_extract(raw_log, '{_RE}', 3), ' ', 2) AS usr,
  split_part(regexp_extract(raw_log, '{_RE}', 3), ' ', 4) AS typ, strptime(regexp_extract(raw_log, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') AS ts
  FROM {_LINES} WHERE regexp_matches(raw_log, '{_RE}')),
o AS (SELECT *, first_value(typ) OVER w AS one, row_number() OVER w AS r, count(DISTINCT typ) OVER (PARTITION BY level) AS types FROM p
  WINDOW w AS (PARTITION BY level ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING)),
d AS (SELECT level, min(r) FILTER (typ <> one) AS other FROM o GROUP BY 1)"""


@query(f"""
WITH {_MINED}
SELECT level, CAST(1 AS BIGINT) AS "TemplateId", 'user <:NUM:> did ' || CASE WHEN r >= coalesce(other, r + 1) THEN '<*>' ELSE one END || ' no <:NUM:>' AS "EventTemplate",
  count(*) AS n FROM o JOIN d USING (level) GROUP BY ALL
""")
def drain_templates(spark, sf_dir):
    """Templates as they were when each line was seen: lines differ in one word, so one template
    takes them all, with a wildcard from the first other word on."""
    rows = parse_lines(synthetic_lines(spark, sf_dir), _strict())
    return templates.mined_templates(rows.withColumn("level", F.col("LogLevel")), MASKS, "level").groupBy("level", "TemplateId", "EventTemplate").agg(F.count("*").alias("n"))


@query(f"""
WITH {_MINED}
SELECT line_no, level, CAST(1 AS BIGINT) AS "TemplateId", 'user <:NUM:> did ' || CASE WHEN types > 1 THEN '<*>' ELSE one END || ' no <:NUM:>' AS "EventTemplate",
  usr || CASE WHEN types > 1 THEN '|' || typ ELSE '' END || '|' || line_no AS parameters FROM o
""")
def drain_distinct_templates(spark, sf_dir):
    """Distinct masked messages mined, lines joined to their last templates in parallel."""
    rows = parse_lines(synthetic_lines(spark, sf_dir), _strict()).withColumn("level", F.col("LogLevel"))
    found = templates.distinct_templates(rows, MASKS, "level")
    return found.select("line_no", "level", "TemplateId", "EventTemplate", F.array_join("Parameters", "|").alias("parameters"))


def _jobs(spark, sf_dir) -> DataFrame:
    """Messages of 120 kinds in each of three streams: lines of one kind differ in a number and
    a word, kinds of one type in three words of ten."""
    hour = F.hour("ts")
    mark = [F.concat(F.lit(x), F.char(F.lit(97) + hour)) for x in "abc"]
    words = [F.lit("job"), F.col("event_type"), F.lit("state"), *mark, F.lit("user"), F.col("user_id").cast("string"), F.lit("by"),
             F.concat(F.lit("w"), F.char((F.lit(97) + F.col("event_id") % 7).cast("int")))]
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("datastream"), F.col("ts").alias("Timestamp"),
        F.col("event_id").alias("line_no"), F.concat_ws(" ", *words).alias("Content"),
    )


@query("""
WITH e AS (SELECT 's' || user_id % 3 AS datastream, ts, event_id, event_type AS t, chr(CAST(97 + hour(ts) AS INTEGER)) AS h, 'w' || chr(CAST(97 + event_id % 7 AS INTEGER)) AS w, user_id FROM events),
k AS (SELECT datastream, t, h, CASE WHEN count(DISTINCT w) > 1 THEN '<*>' ELSE any_value(w) END AS last, min((ts, event_id)) AS first FROM e GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY datastream ORDER BY first) AS id FROM k)
SELECT event_id AS line_no, datastream, id AS "TemplateId", 'job ' || t || ' state a' || h || ' b' || h || ' c' || h || ' user <:NUM:> by ' || last AS "EventTemplate",
  user_id || CASE WHEN last = '<*>' THEN '|' || w ELSE '' END AS parameters FROM e JOIN i USING (datastream, t, h)
""")
def drain_merged_templates(spark, sf_dir):
    """120 templates a stream, told apart by the threshold; parts small enough to be merged."""
    config = ParsingConfig(similarity_threshold=0.8, masking_rules=MASKS.masking_rules)
    found = mining.merged_templates(_jobs(spark, sf_dir), config, "datastream", part=16)
    return found.select("line_no", "datastream", "TemplateId", "EventTemplate", F.array_join("Parameters", "|").alias("parameters"))


@query()
def strategy_comparison(spark, sf_dir):
    def config(**k):
        return PipelineConfig(None, _strict(), windowing=WindowingConfig(**k))

    return compare_strategies(events(spark, sf_dir), {
        "fixed": config(window_size="6h"), "sliding": config(strategy="sliding", window_size="6h", step_size="3h"),
        "session": config(strategy="session", session_timeout="10m"), "adaptive": config(strategy="adaptive", min_window_size="1h", max_window_size="9h"),
    })


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS "Window", event_type AS "EventTemplate", count(*) AS cnt FROM events GROUP BY ALL""")
def stream_fixed_counts(spark, sf_dir):
    """The events as a stream of one bounded run: what the watermark released, and the flush."""
    from stratalog.streaming.pipeline import flush_counts, start, window_counts

    rows = events(spark, sf_dir)
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select(F.col("ts").alias("Timestamp"), F.col("event_type").alias("EventTemplate"))
    folder = shared_folder(spark, "stream")
    start(window_counts(stream, "6h"), folder, f"{folder}/checkpoint").awaitTermination()
    emitted = spark.read.schema("Window timestamp_ntz, EventTemplate string, cnt long").parquet(f"{folder}/event_matrix.parquet")
    return emitted.unionByName(flush_counts(rows, emitted, "6h"))


@query("""
WITH b AS (SELECT min(ts) AS lo FROM events),
f AS (SELECT count(DISTINCT time_bucket(INTERVAL 6 HOUR, ts)) AS n FROM events),
s AS (SELECT count(DISTINCT k) AS n FROM (SELECT unnest(range(CASE WHEN o >= 21600000000 THEN (o - 21600000000) // 10800000000 + 1 ELSE 0 END, o // 10800000000 + 1)) AS k
  FROM (SELECT date_diff('microsecond', lo, ts) AS o FROM events, b))),
g AS (SELECT CAST(sum(CASE WHEN gap IS NULL OR trunc(gap) > 600 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (
  SELECT date_part('epoch', ts) - date_part('epoch', lag(ts) OVER (ORDER BY ts, event_id)) AS gap FROM events))
SELECT 'fixed' AS strategy, n AS windows FROM f UNION ALL SELECT 'sliding', n FROM s UNION ALL SELECT 'session', n FROM g
""")
def strategy_window_counts(spark, sf_dir):
    def config(**k):
        return PipelineConfig(None, _strict(), windowing=WindowingConfig(**k))

    return compare_strategies(events(spark, sf_dir), {
        "fixed": config(window_size="6h"), "sliding": config(strategy="sliding", window_size="6h", step_size="3h"),
        "session": config(strategy="session", session_timeout="10m"),
    }).select("strategy", "windows")


@query("""
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS "Window", event_type AS "EventTemplate", count(*) AS cnt FROM events
WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
""")
def stream_emitted_counts(spark, sf_dir):
    """What the stream itself emits: four files in time order, one to a micro-batch, windows
    given out as the watermark passes their ends."""
    from stratalog.streaming.pipeline import start, window_counts

    rows = events(spark, sf_dir).select("Timestamp", "EventTemplate")
    low, high = rows.agg(F.min("Timestamp"), F.max("Timestamp")).first()
    folder = shared_folder(spark, "stream")
    cuts = [low + (high - low) * k / 4 for k in range(1, 4)]
    quarter = sum((F.col("Timestamp") >= F.lit(c)).cast("int") for c in cuts)
    for k in range(4):
        rows.where(quarter == k).repartition(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start(window_counts(stream, "6h"), folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("Window timestamp_ntz, EventTemplate string, cnt long").parquet(f"{folder}/event_matrix.parquet")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS "Window", event_type AS "EventTemplate", count(*) AS cnt FROM events GROUP BY ALL""")
def stream_corrected_counts(spark, sf_dir):
    """Rows in any order, four files to as many micro-batches, the query being started again after
    two of them: what its corrections add up to is what a batch counts."""
    from stratalog.streaming.pipeline import corrected_counts, folded, start

    rows = events(spark, sf_dir).select("Timestamp", "EventTemplate", "line_no")
    folder = shared_folder(spark, "stream")
    for half in (0, 2):
        for k in (half, half + 1):
            rows.where(F.pmod(F.xxhash64("line_no"), F.lit(4)) == k).drop("line_no").repartition(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("Timestamp timestamp_ntz, EventTemplate string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        start(corrected_counts(stream, "6h"), folder, f"{folder}/checkpoint", "corrections").awaitTermination()
    schema = "Window timestamp_ntz, EventTemplate string, old long, new long"
    return folded(spark.read.schema(schema).parquet(f"{folder}/corrections.parquet"))


@query("""
WITH s AS (SELECT event_type AS datastream, time_bucket(INTERVAL 1 HOUR, ts) AS w, round(max(value), 6) AS v FROM events GROUP BY ALL),
g AS (SELECT *, last_value(CASE WHEN v > 98 THEN 1 WHEN v < 90 THEN 0 END IGNORE NULLS) OVER (PARTITION BY datastream ORDER BY w) AS is_open FROM s),
c AS (SELECT *, coalesce(is_open, 0) AS o, coalesce(lag(is_open) OVER (PARTITION BY datastream ORDER BY w), 0) AS before FROM g)
SELECT datastream, w AS "Window", CASE WHEN o = 1 THEN 'open' ELSE 'close' END AS change, v AS "AnomalyScore" FROM c WHERE o <> before
""")
def stream_alerts(spark, sf_dir):
    """Alerts of five streams of scores in order, day by day: opened above 98, closed below 90."""
    from stratalog.streaming.pipeline import AlertRule, alerts, start

    scores = windows.fixed_windows(events(spark, sf_dir), "1h").groupBy(F.col("EventTemplate").alias("datastream"), "Window").agg(F.round(F.max("value"), 6).alias("AnomalyScore"))
    low, high = scores.agg(F.min("Window"), F.max("Window")).first()
    folder, cuts = shared_folder(spark, "alerts"), [low + (high - low) * k / 4 for k in range(1, 4)]
    quarter = sum((F.col("Window") >= F.lit(c)).cast("int") for c in cuts)
    for k in range(4):
        scores.where(quarter == k).repartition(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rule = AlertRule(98, 90, every=10**9, silence=10**9)
    start(alerts(stream, rule), folder, f"{folder}/checkpoint", "alerts").awaitTermination()
    return spark.read.schema("datastream string, Window timestamp_ntz, change string, AnomalyScore double").parquet(f"{folder}/alerts.parquet")


@query(_pca_sql("SELECT ts, event_type AS t FROM events"))
def stream_incremental_scores(spark, sf_dir):
    """Hourly counts in four batches, each leaving its sums: the model after the last of them is
    that of all windows."""
    from stratalog.streaming.moments import MomentStore, scored_stream

    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    folder = shared_folder(spark, "moments")
    part = F.pmod(F.xxhash64("Window"), F.lit(4))
    for k in range(4):
        counts.where(part == k).repartition(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = MomentStore(spark, folder)
    scored_stream(stream, store, _FOUR_OF_FIVE, f"{folder}/checkpoint").awaitTermination()
    return store.detector(_FOUR_OF_FIVE).score(counts).withColumn("AnomalyScore", F.round("AnomalyScore", 5))


@query()
def isolation_forest_scores(spark, sf_dir):
    """The hourly counts by an isolation forest with a fixed seed."""
    counts = matrix.event_counts(windows.fixed_windows(events(spark, sf_dir), "1h"))
    return scoring.detect(counts, AnomalyConfig(algorithm="isolation_forest"))


def _line_files(spark, sf_dir) -> str:
    """The synthetic lines as text files in line order, a blank line after each tenth."""
    folder = shared_folder(spark, "lines")
    line = F.when(F.col("line_no") % 10 == 0, F.concat("raw_log", F.lit("\n  "))).otherwise(F.col("raw_log"))
    synthetic_lines(spark, sf_dir).orderBy("line_no").select(line.alias("value")).write.text(folder)
    return folder


@query(f"SELECT raw_log, row_number() OVER (ORDER BY line_no) AS line_no FROM {_LINES}")
def load_text(spark, sf_dir):
    """Raw text through load_dataset: blank lines are no rows and have no numbers."""
    return load_dataset(spark, DatasetConfig(path=_line_files(spark, sf_dir)))


def _sinks(name: str):
    return f"SELECT '{name}' AS fmt, c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer"


@query("\nUNION ALL\n".join(map(_sinks, ("parquet", "json", "csv"))))
def sink_round_trip(spark, sf_dir):
    """A stage saved in all formats and loaded again by its suffix."""
    rows = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))
    folder, out = shared_folder(spark, "sinks"), None
    for path in save_stages({"customers": rows, "none": rows.limit(0)}, folder, ["parquet", "json", "csv", "unknown"]):
        found = load_dataset(spark, DatasetConfig(path=path, format=None))
        part = found.select(F.lit(path.rpartition(".")[2]).alias("fmt"), *[F.col(c).cast(kind) for c, kind in rows.dtypes])
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id, user_id, event_type, ts, value, props FROM events")
def json_array_round_trip(spark, sf_dir):
    """Events stored as JSON documents that are arrays, read again split by split."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", "props")
    folder = f"{shared_folder(spark, 'arrays')}.json"
    write_json_arrays(rows, folder)
    found = load_dataset(spark, DatasetConfig(path=folder, format=None))
    return found.select(*[F.col(c).cast(kind) for c, kind in rows.dtypes])


def _run_config(spark, sf_dir, **windowing) -> PipelineConfig:
    return PipelineConfig(
        DatasetConfig(path=_line_files(spark, sf_dir)), _strict(), MASKS, WindowingConfig(**windowing), _FOUR_OF_FIVE,
        OutputConfig(shared_folder(spark, "run"), True, ["parquet"]),
    )


_PARSED = f"""SELECT strptime(regexp_extract(raw_log, '{_RE}', 1), '%Y-%m-%d %H:%M:%S') AS ts, split_part(regexp_extract(raw_log, '{_RE}', 3), ' ', 4) AS t
FROM {_LINES} WHERE regexp_matches(raw_log, '{_RE}')"""


@query(_pca_sql(_PARSED, 'n AS "LogCount",'))
def batch_run(spark, sf_dir):
    """A whole run, from text files to scores, as it was saved."""
    config = _run_config(spark, sf_dir, window_size="1h")
    BatchPipeline(spark, config, CLOCK).run()
    found = read_results(spark, f"{config.output.directory}/{CLOCK:%Y%m%d-%H%M%S}", "anomalies")
    return found.select("Window", "LogCount", F.round("AnomalyScore", 5).alias("AnomalyScore"), "IsAnomaly")


@query(f"""
WITH p AS ({_PARSED}) SELECT count(*) AS total_logs, count(DISTINCT t) AS unique_templates, count(DISTINCT time_bucket(INTERVAL 1 HOUR, ts)) AS total_windows FROM p
""")
def batch_run_summary(spark, sf_dir):
    _, summary = BatchPipeline(spark, _run_config(spark, sf_dir, window_size="1h"), CLOCK).run(save=False)
    names = ("total_logs", "unique_templates", "total_windows")
    return spark.createDataFrame([tuple(summary[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"""
WITH p AS ({_PARSED}) SELECT time_bucket(INTERVAL 1 DAY, ts) AS "Window", min(ts) AS "WindowStart", max(ts) AS "WindowEnd", count(*) AS "LogCount" FROM p GROUP BY 1
""")
def chunk_run(spark, sf_dir):
    """Lines fed chunk by chunk: each window once, whichever chunks its lines were in."""
    from stratalog.streaming.pipeline import ChunkPipeline

    config = _run_config(spark, sf_dir, window_size="1d")
    folder, numbered = shared_folder(spark, "chunks"), shared_folder(spark, "numbered")
    load_dataset(spark, config.dataset).write.parquet(numbered)
    lines, n = spark.read.parquet(numbered), max(1000, -(-table(spark, sf_dir, "events").count() // 4))
    last = lines.agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
    chunks = (lines.where(F.col("line_no").between(k + 1, k + n)) for k in range(0, last, n))
    ChunkPipeline(spark, config, folder, CLOCK).process_stream(chunks)
    return read_results(spark, folder, "windowed").select("Window", "WindowStart", "WindowEnd", "LogCount")


_FORMS = ("%a %b %d %H:%M:%S %Y", "%Y-%m-%d-%H.%M.%S.%f", "%y%m%d %H%M%S", "%Y/%m/%d %H:%M:%S", "UNIX")


@query("\nUNION ALL\n".join(
    f"SELECT event_id, '{f}' AS form, " + ("ts" if "f" in f else "date_trunc('second', ts)") + ' AS "Timestamp" FROM events' for f in (*_FORMS, "inferred")
))
def timestamp_round_trip(spark, sf_dir):
    """Every event's time, written in each form and parsed again."""
    forms = {
        "%a %b %d %H:%M:%S %Y": "E MMM dd HH:mm:ss yyyy", "%Y-%m-%d-%H.%M.%S.%f": "yyyy-MM-dd-HH.mm.ss.SSSSSS", "%y%m%d %H%M%S": "yyMMdd HHmmss",
        "%Y/%m/%d %H:%M:%S": "yyyy/MM/dd HH:mm:ss", "inferred": "dd/MM/yyyy HH:mm:ss.SSSSSS",
    }
    e, out = table(spark, sf_dir, "events"), None
    for form in (*_FORMS, "inferred"):
        if form == "UNIX":
            text = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).cast("string")
        else:
            text = F.date_format("ts", forms[form])
        part = e.select("event_id", F.lit(form).alias("form"), parse_time(text, None if form == "inferred" else form).alias("Timestamp"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT user_id AS datastream, CASE WHEN user_id < 10 THEN 'config-' || user_id WHEN user_id < 100 THEN NULL ELSE 'Stream' || user_id || '-b' END AS config, count(*) AS n
FROM events GROUP BY ALL
""")
def routed_streams(spark, sf_dir):
    """Streams to configs: the exact name first, then the first that begins so, else unknown.
    The configs are those of the streams that have one, as many as there are, and such as could be mistaken for them."""
    e = events(spark, sf_dir)
    number = F.col("datastream").cast("string")
    name = F.when(F.col("datastream") < 10, F.concat(F.lit("config-"), number)).otherwise(F.concat(F.lit("STREAM"), number, F.lit("-")))
    whole = [F.concat(F.lit("config-"), number), F.when(F.col("datastream") < 10, F.concat(F.lit("config-"), number, F.lit("-b")))]
    begun = [F.when(F.col("datastream") >= 100, F.concat(F.lit("Stream"), number, F.lit(x))) for x in ("-c", "-b")]
    names = e.select("datastream").distinct().select(F.explode(F.array(*whole, *begun)).alias("config")).where("config IS NOT NULL")
    found = records.routed_requests(e.select(name.alias("datastream"), F.col("datastream").alias("user_id")), names)
    return found.groupBy(F.col("user_id").alias("datastream"), "config").agg(F.count("*").alias("n"))
