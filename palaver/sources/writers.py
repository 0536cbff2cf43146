"""Writers: documents, logs, tables, turn files and result envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from palaver.operators.manifest import upsert
from palaver.operators.render import rttm_lines


def write_json(calls: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object for each call; fields without a value are left out."""
    calls.write.mode(mode).json(path)


def append_usage(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a table that were written to their end."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(done(f"{path}/{n}/_SUCCESS")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of a table."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]:010d}")


def replace_table(table: DataFrame, path: str) -> None:
    """A new version of a table that ``table`` may itself have been read from.

    Readers take the latest whole version, so a crash leaves the one before. The two latest are kept, as a reader may still be at the older one.
    """
    spark = table.sparkSession
    there = versions(spark, path)
    table.write.mode("overwrite").parquet(f"{path}/v{(there[-1] if there else 0) + 1:010d}")
    for old in there[:-1]:
        fs, at = _file_system(spark, f"{path}/v{old:010d}")
        fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def upsert_manifest(rows: DataFrame, path: str) -> None:
    """Merge rows into a manifest table by hash; the latest wins."""
    spark = rows.sparkSession
    replace_table(upsert(read_table(spark, path), rows) if exists(spark, path) else rows, path)


def write_rttm(turns: DataFrame, path: str, buckets: int = 64) -> None:
    """Turn lines of all calls, in at most ``buckets`` files; the lines of a call stand together and in order, and name it."""
    rttm_lines(turns).repartitionByRange(buckets, "call_id").sortWithinPartitions("call_id", "pos").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_embeddings(speakers: DataFrame, path: str) -> None:
    """For each call a JSON object of label to {embedding, dimension}."""
    entry = F.struct(F.col("local_label"), F.struct("embedding", F.size("embedding").alias("dimension")))
    maps = speakers.groupBy("call_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    maps.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str, column: str = "document", buckets: int = 64) -> None:
    """Text documents as Parquet rows (call_id, document), dealt to ``buckets`` folders by a hash of the call, so that one call is found without reading all."""
    named = documents.select("call_id", F.col(column).alias("document"), F.pmod(F.xxhash64("call_id"), F.lit(buckets)).alias("bucket"))
    named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_document(spark: SparkSession, path: str, call_id: str, buckets: int = 64) -> DataFrame:
    """The document of one call out of its bucket."""
    number = F.pmod(F.xxhash64(F.lit(call_id)), F.lit(buckets))
    return spark.read.parquet(path).filter((F.col("bucket") == number) & (F.col("call_id") == call_id)).select("call_id", "document")


def envelope(rows: DataFrame, command: str, version: str = "1.0", elapsed_seconds: float = 0.0) -> DataFrame:
    """(value): each row as compact JSON {ok, command, data, meta}."""
    meta = F.struct(F.lit(version).alias("version"), F.lit(round(elapsed_seconds, 2)).alias("elapsed_seconds"))
    return rows.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(command).alias("command"), F.struct(*rows.columns).alias("data"), meta.alias("meta"))).alias("value"))


def error_envelope(errors: DataFrame) -> DataFrame:
    """(value): rows (code, error_type, message[, hint, docs_url]) as compact JSON {ok, error}; an empty hint or address is left out."""
    more = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("hint", "docs_url") if c in errors.columns]
    return errors.select(F.to_json(F.struct(F.lit(False).alias("ok"), F.struct("code", "error_type", "message", *more).alias("error"))).alias("value"))


def stream_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of results (file, status, ...) as JSON lines, appended as they come, until all that is there is written."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value")).writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


class Progress(StreamingQueryListener):
    """Calls ``say`` with an event for every micro-batch of a query: rows so far and rows a second."""

    def __init__(self, say: Callable[[dict], None]):
        self.say, self.rows = say, 0

    def onQueryStarted(self, event) -> None:
        self.say({"event": "started", "query": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.say({"event": "progress", "query": str(event.progress.runId), "rows": self.rows, "rows_per_second": event.progress.processedRowsPerSecond})

    def onQueryTerminated(self, event) -> None:
        self.say({"event": "ended", "query": str(event.runId), "rows": self.rows})


def export_once(documents: DataFrame, state_path: str, out_path: str) -> None:
    """Write documents (call_id, document) not exported before, and remember them.

    An export goes to the folder of its number, which the state's next version confirms; after a crash in between the same number is written again.
    """
    spark = documents.sparkSession
    done = versions(spark, state_path)
    known = read_table(spark, state_path) if done else None
    new = (documents if known is None else documents.join(known, "call_id", "left_anti")).persist()
    if not new.isEmpty():
        new.write.mode("overwrite").json(f"{out_path}/export={(done[-1] if done else 0) + 1}")
        ids = new.select("call_id")
        replace_table(ids if known is None else known.unionByName(ids), state_path)
    new.unpersist()
