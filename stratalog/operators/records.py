"""Rows as stored log records, and lists and structs as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_value(value: Column) -> Column:
    """A label: backslashes and line ends blank, double quotes single, white space single, at
    most 250 characters."""
    text = F.translate(value.cast("string"), '\\\n"', "  '")
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " "), 1, 250)


def list_text(column: Column) -> Column:
    """['a','b'], or [] for an empty or null list."""
    quoted = F.transform(column.cast("array<string>"), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.when(F.size(column) > 0, F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))).otherwise("[]")


def flat_for_csv(rows: DataFrame) -> DataFrame:
    """rows with lists and structs as text, so that CSV can hold them."""

    def flat(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return list_text(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            return F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        return F.col(f"`{f.name}`")

    return rows.select(*[flat(f) for f in rows.schema.fields])


def _metadata_value(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def log_records(rows: DataFrame, stream: str = "datastream") -> DataFrame:
    """(ts, ts_ns, datastream, EventTemplate, TemplateId, line, meta) of parsed rows.

    The event's own time is stored, or the current one where it is null; line is the row as
    JSON without LineNumber; meta has the other columns that are not null as text.
    """
    rows = rows.drop("LineNumber")
    names = set(rows.columns)
    ts = F.coalesce(F.col("Timestamp"), F.localtimestamp()) if "Timestamp" in names else F.localtimestamp()
    label = F.coalesce(F.col(stream).cast("string"), F.lit("unknown")) if stream in names else F.lit("unknown")
    rest = [f for f in rows.schema.fields if f.name not in {stream, "EventTemplate", "TemplateId"}]
    entries = F.array(*[F.struct(F.lit(f.name).alias("k"), _metadata_value(f).alias("v")) for f in rest]) if rest else F.array()
    meta = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
    template = F.nullif(F.col("EventTemplate"), F.lit("")) if "EventTemplate" in names else F.lit(None).cast("string")
    number = F.col("TemplateId").cast("string") if "TemplateId" in names else F.lit(None).cast("string")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return rows.select(
        ts.alias("ts"), (micros * 1000).cast("string").alias("ts_ns"), label.alias("datastream"),
        label_value(template).alias("EventTemplate"), number.alias("TemplateId"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line"), meta.alias("meta"),
    )


def forwarded(rows: DataFrame) -> DataFrame:
    """Ingest requests of received lines: message, datastream ("unknown" where missing) and
    timestamp (now where missing); nothing else is passed on."""
    null = F.lit(None).cast("string")
    col = lambda n: F.col(n).cast("string") if n in rows.columns else null
    return rows.select(
        col("message").alias("message"), F.coalesce(col("datastream"), F.lit("unknown")).alias("datastream"),
        F.coalesce(col("timestamp"), F.date_format(F.localtimestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
    )


def ingest_status(parsed: Column, template: Column) -> Column:
    """As the ingest service answers: skipped where a line did not parse, no_template where none was found, else ok."""
    return F.when(~parsed, "skipped").when(template.isNull(), "no_template").otherwise("ok")


def config_of_stream(stream: str, names: Iterable[str]) -> str:
    """The config that a stream goes by: the one of its name, else the first by name, in any
    case, that begins with it. An unknown stream is an error."""
    names = sorted(names)
    if stream in names:
        return stream
    found = next((n for n in names if n.lower().startswith(stream.lower())), None)
    if not stream or found is None:
        raise LookupError(f"Unknown datastream {stream!r}")
    return found


def routed_requests(requests: DataFrame, names: Iterable[str] | DataFrame) -> DataFrame:
    """requests with config, by the rule of config_of_stream, null where the stream is unknown.
    names: the configs, or a table of them (config). Streams meet the names that begin so by all
    beginnings of a name, of which each keeps its first name."""
    if not isinstance(names, DataFrame):
        names = requests.sparkSession.createDataFrame([(n,) for n in names], "config string")
    known = names.select("config").distinct()
    streams = requests.select("datastream").distinct().where("datastream <> ''")
    lower = F.lower("config")
    begins = known.select("config", F.explode(F.sequence(F.lit(1), F.length(lower))).alias("n")).where("config <> ''")
    begins = begins.groupBy(F.substring(lower, F.lit(1), F.col("n")).alias("begin")).agg(F.min("config").alias("first"))
    exact = known.select(F.col("config").alias("datastream"), "config")
    found = streams.join(exact, "datastream", "left").join(begins, F.lower("datastream") == F.col("begin"), "left")
    return requests.join(found.select("datastream", F.coalesce("config", "first").alias("config")), "datastream", "left")
