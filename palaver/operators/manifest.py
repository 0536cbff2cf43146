"""Incremental processing by content hash: diff, hash cache, upsert, patch and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_against_manifest(entries: DataFrame, manifest: DataFrame, tier: str, version: str) -> DataFrame:
    """Entries (hash, ...) without a completed row for this tier and version; entries without a hash are dropped."""
    done = manifest.filter((F.col("status") == "completed") & (F.col("tier") == tier) & (F.col("version") == version)).select("hash")
    return entries.filter("hash IS NOT NULL").join(done, "hash", "left_anti")


def first_of_hash(entries: DataFrame, order: str) -> DataFrame:
    """The first entry of each content hash, reduced in each task before the shuffle; entries without a hash are dropped."""
    found = entries.filter("hash IS NOT NULL").groupBy("hash").agg(F.min_by(F.struct(*entries.columns), F.col(order)).alias("_e"))
    return found.select("_e.*")


def cached_hashes(entries: DataFrame, cache: DataFrame, content_hash: Column) -> DataFrame:
    """``entries`` with ``hash`` and ``cache_hit``: from the cache if (path, size, mtime) is known, else computed."""
    known = cache.select("path", "size", "mtime", F.col("hash").alias("_known"))
    joined = entries.drop("hash").join(known, ["path", "size", "mtime"], "left")
    return joined.withColumn("cache_hit", F.col("_known").isNotNull()).withColumn("hash", F.when(F.col("_known").isNotNull(), F.col("_known")).otherwise(content_hash)).drop("_known")


def upsert(old: DataFrame, new: DataFrame, key: str = "hash", order: str = "last_updated") -> DataFrame:
    """Rows of both with the latest of each key; of equal times the new one. Reduced in each task before the shuffle."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("_new"))).alias("_r")).select("_r.*")


def patch(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """``old`` with the fields of ``new`` that are not null; unknown keys are added. A stale error stays after a success."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    columns = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return joined.select(*columns)


def current_errors(manifest: DataFrame) -> DataFrame:
    """The manifest with errors of completed rows cleared."""
    done = F.col("status") == "completed"
    return manifest.withColumn("error", F.when(~done, F.col("error"))).withColumn("error_category", F.when(~done, F.col("error_category")))


def status_counts(manifest: DataFrame, known: list[str] | None = None, column: str = "status") -> DataFrame:
    """(status, n) with zeros for the known states; any other state is counted too."""
    spark = manifest.sparkSession
    states = known or ["pending", "transcribed", "completed", "error"]
    zero = spark.createDataFrame([(s,) for s in states], "status string")
    counts = manifest.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    return zero.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def sync_report(entries: DataFrame) -> DataFrame:
    """(source, found, processed, failed, skipped): per source and, with a null source, in total."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return entries.rollup("source").agg(F.count("*").alias("found"), is_("completed").alias("processed"), is_("error").alias("failed"), is_("skipped").alias("skipped"))


def by_availability(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that are there, and those still in the cloud; the ones whose probe failed are in neither."""
    return entries.filter(F.col("availability") == "local"), entries.filter(F.col("availability") == "cloud")


def all_files(*tables: DataFrame) -> DataFrame:
    """Files of several places, each path once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.dropDuplicates(["path"])
