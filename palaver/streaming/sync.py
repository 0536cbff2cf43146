"""Continuous ingestion: new recordings once each by content hash, tier and version; and live sessions.

The manifest table is the memory, so losing a checkpoint repeats no work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palaver.operators.manifest import diff_against_manifest, first_of_hash
from palaver.operators.rules import backoff_seconds, error_category, should_retry
from palaver.schemas import MANIFEST
from palaver.sources.writers import exists, read_table, upsert_manifest, versions

Process = Callable[[DataFrame], DataFrame]


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def results(spark: SparkSession, out: str, manifest: str) -> DataFrame:
    """What finished cycles have written; a cycle that broke off before its manifest is not shown."""
    return spark.read.parquet(out).filter(F.col("cycle") <= max(versions(spark, manifest), default=0)).drop("cycle")


#: What a manifest holds besides its own columns: how often an entry was tried, and when it is due again (null: never).
RETRY = "attempts int, due double"


def due_again(known: DataFrame, entries: DataFrame, tier: str, version: str, now: float) -> DataFrame:
    """Entries that failed before and are due, as they were first seen, with their number of attempts."""
    failed = known.filter((F.col("status") == "error") & (F.col("tier") == tier) & (F.col("version") == version) & (F.col("due") <= now))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return failed.select(F.from_json("checkpoint", schema).alias("_e"), "attempts").select("_e.*", "attempts")


def run_once(entries: DataFrame, process: Process, out: str, manifest: str, tier: str, version: str, now: float, order: str = "path", most: int = 0, strategy: str = "smart", attempts: int = 3) -> DataFrame:
    """Process the entries (hash, path, ...) the manifest does not have and those due again, write the result, and record them.

    A cycle writes to the folder of its number, the manifest's next version, and that version confirms it: after a crash in between the next run writes the same folder again, so nothing appears twice.
    ``process`` gets the entries with ``attempts`` made before, and may return ``hash``, ``error_type`` and ``error``; rows with an error are not written but recorded with their category. As ``strategy`` says
    (smart: transient errors only) they are due again after 1, 2, 4 ... seconds, 10 at the most, until ``attempts`` have been made; the manifest keeps the entry itself (as JSON in ``checkpoint``), so it need not be listed again.
    ``most`` over zero bounds a cycle. With nothing new the work is the listing and the anti-join. Returns the entries of this cycle.
    """
    spark = entries.sparkSession
    known = manifest_of(spark, manifest)
    for column in (x.strip().split(" ") for x in RETRY.split(",")):
        if column[0] not in known.columns:
            known = known.withColumn(column[0], F.lit(None).cast(column[1]))
    failed = known.filter((F.col("status") == "error") & (F.col("tier") == tier) & (F.col("version") == version)).select("hash")
    fresh = diff_against_manifest(first_of_hash(entries, order), known, tier, version).join(failed, "hash", "left_anti")
    new = fresh.withColumn("attempts", F.lit(0)).unionByName(due_again(known, entries, tier, version, now))
    if most:
        new = new.orderBy(order).limit(most)
    new = new.persist()
    if not new.isEmpty():
        done = process(new)
        entry = F.to_json(F.struct(*entries.columns))
        rows = new.select("hash", F.lit("completed").alias("status"), F.lit(tier).alias("tier"), F.lit(version).alias("version"), F.lit(now).alias("last_updated"), F.col(order).cast("string").alias("filename"), (F.col("attempts") + 1).alias("attempts"), entry.alias("_entry"))
        if "error_type" in done.columns:
            done = done.persist()
            wrong = done.filter("error_type IS NOT NULL").select("hash", "error", error_category(F.col("error_type"), F.col("error")).alias("error_category")).dropDuplicates(["hash"])
            is_wrong = F.col("error_category").isNotNull()
            again = should_retry(F.col("error_category"), F.lit(strategy), F.col("attempts"), F.lit(attempts))
            rows = rows.join(wrong, "hash", "left").withColumns({
                "status": F.when(is_wrong, "error").otherwise(F.col("status")), "checkpoint": F.when(is_wrong & again, F.col("_entry")), "due": F.when(is_wrong & again, now + backoff_seconds(F.col("attempts"))),
            })
            done = done.filter("error_type IS NULL").drop("error_type", "error")
        done.drop(*({"attempts"} - set(entries.columns))).write.mode("overwrite").parquet(f"{out}/cycle={max(versions(spark, manifest), default=0) + 1}")
        kinds = [x.strip().split(" ", 1) for x in f"{MANIFEST}, {RETRY}".split(",")]
        upsert_manifest(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds]), manifest)
    return new


def watch(stream: DataFrame, process: Process, out: str, manifest: str, checkpoint: str, tier: str, version: str, now: Callable[[], float], order: str = "path", seconds: float | None = None, **retry) -> StreamingQuery:
    """A query over a stream of entries: each micro-batch is one ``run_once``. Without ``seconds`` it takes what there is and ends.

    With ``seconds`` a tick joins every trigger, so that entries whose retry is due are taken even while nothing new arrives.
    """

    def step(batch: DataFrame, _: int) -> None:
        run_once(batch, process, out, manifest, tier, version, now(), order, **retry).unpersist()

    if seconds:
        ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", "1").option("numPartitions", "1").load()
        # Rows without a hash are no entries.
        stream = stream.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]))
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def file_stream(spark: SparkSession, folder: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """New files of a folder as entries (path, size, mtime, hash)."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if most:
        reader = reader.option("maxFilesPerTrigger", str(most))
    return reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))


def live_sessions(stream: DataFrame, end: Column, min_pause: float = 3.0, late: str = "10 minutes") -> DataFrame:
    """Sessions of a live segment stream (call_id, ts, text): a gap of ``min_pause`` after a segment's end begins a new one.

    A window closes a microsecond before the pause is full, so a gap of exactly ``min_pause`` splits.
    """
    length = F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros("ts")) / 1e6) + min_pause - 1e-6
    gap = F.concat(F.format_string("%.6f", length), F.lit(" seconds"))
    return stream.withWatermark("ts", late).groupBy("call_id", F.session_window("ts", gap)).agg(F.count("*").alias("segments")).select("call_id", F.col("session_window.start").alias("start"), "segments")


CLUSTER_STATE = "place bigint, total array<double>, n bigint, status int"
OPEN_STATE = "call_order double, call_id string, seconds double, local_label string, vector array<double>, cluster string, ended boolean"
RESOLVED = "call_id string, local_label string, speaker_cluster_id string, status string, confidence double, source string"


def resolver(threshold: float, idle_ms: int):
    """The processor of ``resolve_stream``, made where it is used, as sessions without streams need not load its parts."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    from palaver.operators.identity import Clusters

    columns = [c.strip().split(" ")[0] for c in RESOLVED.split(",")]

    class Resolver(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.clusters = handle.getMapState("clusters", "cluster string", CLUSTER_STATE)
            self.open = handle.getListState("open", OPEN_STATE)

        def resolve(self, rows: list[tuple]) -> pd.DataFrame:
            """Speakers of whole calls, one after the other; only the clusters that change are written back."""
            state, found = Clusters(threshold), []
            for (cluster,), (_, total, n, status) in sorted(self.clusters.iterator(), key=lambda x: x[1][0]):
                at = state.create(cluster, np.asarray(total, float), 1, int(status))
                state.counts[at] = int(n)
            changed, call, used = set(), object(), set()
            for _, call_id, _, label, vector, cluster, _ in sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3])):
                if call_id != call:
                    call, used = call_id, set()
                vector = np.asarray(vector, float)
                at, score = state.match(vector, used)
                if at >= 0:
                    found.append((call_id, label, state.ids[at], state.update(at, vector, score), score, "db_match"))
                else:
                    at = state.create(cluster, vector)
                    found.append((call_id, label, cluster, "unknown", 1.0, "auto_cluster"))
                used.add(at)
                changed.add(at)
            for at in changed:
                self.clusters.updateValue((state.ids[at],), (at, [float(x) for x in state.sums[at]], int(state.counts[at]), int(state.status[at])))
            return pd.DataFrame(found, columns=columns)

        def keep(self, rows: list[tuple], now: int) -> None:
            """Rows of calls that are still open; a timer closes them if nothing more comes."""
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            if rows:
                self.open.put(rows)
                self.handle.registerTimer(now + idle_ms)
            elif self.open.exists():
                self.open.clear()

        def handleInputRows(self, key, rows, timerValues):
            here = [(*map(float, r[:1]), str(r[1]), float(r[2]), r[3], None if r[4] is None else [float(x) for x in r[4]], r[5], bool(r[6])) for b in rows for r in b[[c.split(" ")[0] for c in OPEN_STATE.split(", ")]].itertuples(index=False)]
            here += [tuple(r) for r in self.open.get()] if self.open.exists() else []
            last = max((r[0], r[1]) for r in here)
            ended = {r[1] for r in here if r[6]}
            # A call is whole when a later one has begun, or when its end is told.
            whole = [r for r in here if r[3] is not None and ((r[0], r[1]) < last or r[1] in ended)]
            self.keep([r for r in here if not ((r[0], r[1]) < last or r[1] in ended)], timerValues.getCurrentProcessingTimeInMs())
            if whole:
                yield self.resolve(whole)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            rows = [tuple(r) for r in self.open.get()] if self.open.exists() else []
            if rows:
                self.open.clear()
                yield self.resolve([r for r in rows if r[3] is not None])

        def close(self) -> None:
            pass

    return Resolver()


def resolve_stream(stream: DataFrame, threshold: float = 0.7, idle_seconds: float = 600.0) -> DataFrame:
    """Speakers of a stream of calls resolved against the clusters of their tenant, which live in the state store.

    stream: (tenant, call_id, call_order, local_label, embedding, speaking_seconds[, ended]). The speakers of a call may come in several micro-batches: they are kept until the call is whole, that is until a later call of the
    tenant begins, a row says ``ended`` (its label may be null), or nothing has come for ``idle_seconds``. Calls of a tenant come in order; a row that is later than the calls after it is resolved as a call of its own.
    The state is a map by cluster, of which a call rewrites the clusters it meets, and the rows of the open call. It needs the state store that keeps several states
    (``spark.sql.streaming.stateStore.providerClass`` = RocksDBStateStoreProvider), and a trigger by time: because of its timers the query always has a next micro-batch.
    """
    from palaver.functions.scalars import stable_id

    ended = F.coalesce(F.col("ended"), F.lit(False)) if "ended" in stream.columns else F.lit(False)
    keyed = stream.select(
        "tenant", F.col("call_order").cast("double").alias("call_order"), F.col("call_id").cast("string").alias("call_id"), F.col("speaking_seconds").cast("double").alias("seconds"), F.col("local_label").cast("string").alias("local_label"),
        F.col("embedding").cast("array<double>").alias("vector"), stable_id("spk_", 8, F.col("call_id").cast("string"), F.col("local_label").cast("string")).alias("cluster"), ended.alias("ended"),
    )
    return keyed.groupBy("tenant").transformWithStateInPandas(resolver(threshold, int(1000 * idle_seconds)), RESOLVED, "Append", "ProcessingTime")
