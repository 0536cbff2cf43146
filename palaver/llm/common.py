"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.storage import settled as settle
from palaver.storage import shared_folder

__all__ = ["ascii_lower", "bitmap", "crc_mod", "fresh", "in_bitmap", "join_split", "no_broadcasts", "row_key", "runs", "settle", "shared_folder", "slices", "small_batches", "stored", "table"]

#: Bits of the map that filters rows before a shuffle.
BITMAP = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage of a large table: written to the shared folder as Parquet, which is far smaller than a checkpoint, and read again.

    With ``by`` the values of a column have folders of their own, so that a filter on it reads no others.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Work run inside sends at most about ``size`` of rows to Python at once, so that texts take little memory on either side; the session's setting comes back after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is None:  # a Spark without this setting
        yield
        return
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins run inside are shuffled unless one side is marked to be broadcast, so that jobs with many joins of small tables don't build these in the driver's memory, one beside the other; the session's settings come back after it."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(name, None) for name in names]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def slices(items: Iterable[bytes | None], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes each, with the index of the first; null becomes empty."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(items):
        held.append(text or b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner", often: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row for each value of ``key``; nulls are equal.

    A value that holds more than one in ``often`` of the rows of ``left`` (fewer than ``often`` values do, whatever the table) would gather its rows in one
    task. The rows of ``right`` for such values are broadcast, so their partners stay where they are; all others meet by a shuffle.
    ``left`` is read three times, so it should be a table that is stored. ``counts`` (key, count) are those of the rows of ``left``, if they are known.
    """
    rows = left.count()
    # Fewer than ``often`` rows by the filter.
    found = (left.groupBy(key).count() if counts is None else counts).filter(F.col("count") * often > rows).select(key).collect()
    k = f"_{key}"
    while k in {*left.columns, *right.columns}:
        k = f"_{k}"
    named = right.withColumnRenamed(key, k)
    plain = lambda a, b: a.join(b, a[key].eqNullSafe(b[k]), how).drop(k)
    if not found:
        return plain(left, named)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, left.select(F.col(key).alias(k)).schema))
    is_hot = lambda a, c, kind: a.join(hot, c.eqNullSafe(hot[k]), kind)
    few = right.join(hot, right[key].eqNullSafe(hot[k]), "left_semi").withColumnRenamed(key, k)
    return plain(is_hot(left, left[key], "left_semi"), F.broadcast(few)).unionByName(plain(is_hot(left, left[key], "left_anti"), named))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a partition that is sorted by the first one, so that no value of it goes on in the next part."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if whole:
            yield [c[:whole] for c in now]
        held = [c[whole:] for c in now]
    if held is not None and len(held[0]):
        yield held


def bitmap(needed: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the hashes ``key`` in ``needed``. The driver gets words of 64 bits, of which there are BITMAP / 64 at most, however many hashes there are."""
    at = F.pmod("key", F.lit(BITMAP))
    found = needed.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    words = np.zeros(BITMAP // 64, "<i8")
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return np.packbits(np.unpackbits(words.view(np.uint8), bitorder="little"))


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that are none of those in the bitmap."""
    at = hashes & (BITMAP - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns without nulls that tell rows apart, with the id: whether it is missing, and a hash of the text. They sort by id, rows without one last."""
    return [F.col(id_col).isNull().alias("_none"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_mark")]
