"""Registration of queries, and the inputs that they derive from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as segments: (call_id, pos, text)."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select(F.col("doc_id").alias("call_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


LINES = "lines AS (SELECT doc_id AS call_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as timed turns, 600 seconds long for each unit of value: (call_id, pos, start, end, speaker)."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2023-11-14 22:13:20', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("pos"), start.alias("start"), "value", F.col("event_type").alias("speaker"))
    return rows.select("call_id", "pos", "start", (F.col("start") + F.col("value") * 600).alias("end"), "speaker")


EVENTS = "ev AS (SELECT user_id AS call_id, event_id AS pos, (epoch_us(ts) - 1700000000000000) / 1e6 AS s0, (epoch_us(ts) - 1700000000000000) / 1e6 + value * 600 AS s1, event_type AS speaker FROM events), seg AS (SELECT * FROM ev WHERE speaker = 'view'), turn AS (SELECT * FROM ev WHERE speaker <> 'view')"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments: (call_id, pos, speaker, text)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text")


def timed_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with times: a turn lasts a second for every 20 characters and begins a second after the one before it would at 30 seconds each."""
    return chats(spark, sf_dir).withColumn("start", F.col("pos") * 30.0).withColumn("end", F.col("pos") * 30.0 + F.length("text") / 20.0)


CHATS = "ch AS (SELECT conv_id AS call_id, turn AS pos, role AS speaker, text, turn * 30.0::DOUBLE AS s0, turn * 30.0::DOUBLE + length(text) / 20.0::DOUBLE AS s1 FROM conversations)"


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
