"""Token counts through a digest cache: only distinct contents that it lacks are encoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from stratalog.llm.common import by_text, fresh_dir, stored
from stratalog.llm.tokens import chunk_tokenizer, version_digest, vocabulary_path

CACHE_SCHEMA = "digest string, version string, n_tokens long"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for one tokenizer version; none where the cache is new."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `content`, its runs of ASCII white space made one space, and its `digest`.

    The tokenizer drops white space, so texts that differ only there share a count. Null is
    taken as empty.
    """
    content = F.regexp_replace(
        F.coalesce(F.col(text).cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " "
    )
    return docs.withColumn("content", content).withColumn("digest", F.sha2("content", 256))


def fill_cache(docs: DataFrame, cache_path: str, vocabulary: str, version: str) -> None:
    """Append the counts of the distinct contents of docs that the cache lacks.

    Equal contents are merged before the shuffle, so a content that a third of all rows
    share reaches its reducer once per map task. The append is one committed write; should
    two runs append the same digest, reading merges them.
    """
    spark = docs.sparkSession
    distinct = docs.select("digest", "content").dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti")

    def encode(columns):
        digests, contents = columns
        tokenizer = chunk_tokenizer(vocabulary)
        yield pa.RecordBatch.from_pydict(
            {
                "digest": pa.array(digests, pa.string()),
                "version": pa.array([version] * len(digests), pa.string()),
                "n_tokens": pa.array([tokenizer.count(c) for c in contents], pa.int64()),
            }
        )

    def done():
        chunk_tokenizer(vocabulary).forget()

    by_text(misses, ["digest", "content"], CACHE_SCHEMA, encode, done).write.mode("append").parquet(cache_path)


def count_tokens(
    docs: DataFrame, cache_path: str | None = None, vocabulary: str | None = None, limit: int = 2048
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    cache_path: a folder that keeps counts from run to run; None takes a new one in the
    shared folder. Null and empty texts have 0 bytes and 0 tokens; repeated rows and equal
    or null ids come back as often as they are given; an empty table gives none. Columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    cache_path = cache_path or fresh_dir(spark, "token-counts")
    vocabulary = vocabulary or vocabulary_path()
    version = version_digest(vocabulary)
    keyed = with_digest(docs.select("doc_id", "text"))
    fill_cache(keyed, cache_path, vocabulary, version)
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes")
    keys = stored(keyed.select("doc_id", n_bytes, "digest"), "token-keys")
    # both are written out, so that their join meets plain shuffles, whose hot partitions Spark splits
    counts = read_cache(spark, cache_path, version).join(keys.select("digest").distinct(), "digest", "left_semi")
    return (
        keys.join(stored(counts, "token-counts"), "digest", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
