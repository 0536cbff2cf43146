"""Queries of incremental and streaming jobs; each works in a folder of its own and returns what it left there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.scalars import content_hash
from palaver.plans.registry import query, table
from palaver.storage import shared_folder
from palaver.streaming import sync


def _folder(spark: SparkSession, name: str) -> str:
    """A folder on shared storage."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _entries(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("path"), content_hash(F.col("text")).alias("hash"))


@query("sync_stream", "SELECT min(doc_id) AS path, sha256(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 2")
def sync_stream(spark, sf_dir):
    """Documents as a stream of entries, taken twice: the second run finds nothing new."""
    folder = _folder(spark, "sync")
    docs = table(spark, sf_dir, "documents")
    # A file source reads folders; the entries are laid out as one first.
    _entries(docs).repartitionByRange(4, "path").write.parquet(f"{folder}/in")
    for attempt in range(2):
        stream = spark.readStream.schema("path bigint, hash string").parquet(f"{folder}/in")
        sync.watch(stream, lambda new: new.select("path", "hash"), f"{folder}/out", f"{folder}/manifest", f"{folder}/check{attempt}", "draft", "1.0", lambda: 1.0).awaitTermination()
    return sync.results(spark, f"{folder}/out", f"{folder}/manifest").groupBy("hash").agg(F.min("path").alias("path"))


@query("retry_schedule", """WITH d AS (SELECT min(doc_id) % 5 AS k, sha256(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 2)
SELECT hash, CASE WHEN k < 2 THEN 'error' ELSE 'completed' END AS status, [1, 4, 2, 3, 1][k + 1] AS attempts, [0.0, 7.0, 1.0, 3.0, 0.0][k + 1]::DOUBLE AS last_updated, CASE k WHEN 0 THEN 'permanent' WHEN 1 THEN 'transient' END AS error_category FROM d""")
def retry_schedule(spark, sf_dir):
    """Documents that fail for good, always, once, twice or never, under a clock of whole seconds; they are listed in the first cycle alone."""
    folder = _folder(spark, "retry")
    entries = _entries(table(spark, sf_dir, "documents"))
    k, tried = F.col("path") % 5, F.col("attempts")
    fails = F.when(k == 0, "ValueError").when(k == 1, "TimeoutError").when((k == 2) & (tried < 1), "ConnectionError").when((k == 3) & (tried < 2), "MemoryError")
    for now in range(10):
        due = entries if now == 0 else entries.limit(0)
        sync.run_once(due, lambda new: new.select("hash", fails.alias("error_type"), F.lit("no luck").alias("error")), f"{folder}/out", f"{folder}/manifest", "draft", "1.0", float(now), attempts=4).unpersist()
    return sync.manifest_of(spark, f"{folder}/manifest").select("hash", "status", "attempts", "last_updated", "error_category")


@query("live_sessions", """WITH g AS (SELECT user_id AS call_id, ts, CASE WHEN ts >= max(ts + INTERVAL 3600 SECOND) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY call_id ORDER BY ts) AS n FROM g) SELECT call_id, epoch_us(min(ts)) AS start_us, count(*) AS segments FROM s GROUP BY call_id, n""")
def live_sessions(spark, sf_dir):
    """The session operator of the stream over all events as one batch."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"))
    found = sync.live_sessions(rows, F.col("ts"), 3600.0)
    return found.select("call_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "segments")
