"""Operator 7: sharding by jump consistent hashing.

The shard of a row depends on its key and the number of shards alone. There is no ring table,
and a further shard takes 1/(n+1) of the rows, all of them into itself.

Defined cases: a null key counts as key 0; a null text has size 16 and the CRC of the empty
text; repeated rows get the same shard and different slots; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published hash: the multiplier of its generator.
JUMP_MULTIPLIER = np.uint64(2862933555777941757)
OVERHEAD = 16
ROWS_A_BLOCK = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each 64-bit key, for all keys at once; about ln(shards) rounds."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(state), np.int64)
    active, jump = np.arange(len(state)), np.zeros(len(state), np.int64)
    while active.size:
        bucket[active] = jump
        state[active] = state[active] * JUMP_MULTIPLIER + np.uint64(1)
        share = float(1 << 31) / ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((bucket[active] + 1) * share).astype(np.int64)
        stay = jump < shards
        active, jump = active[stay], jump[stay]
    return bucket


def jump_column(docs: DataFrame, key: str, shards: int):
    """``jump_hash`` of ids as a column; only the keys travel to Python. Ids that are no integers are hashed first."""
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key).cast("bigint") if whole else F.xxhash64(F.col(key).cast("string"))

    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.fill_null(0).to_numpy(zero_copy_only=False), shards), pa.int32())

    return bucket(number)


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Shard, place inside the shard and shard after growth by one, for every row.

    Slots are gapless from 0 in each shard. A shard is never sorted as one group: rows are dealt
    to blocks inside their shard by a hash, numbered there, and shifted by the running total of
    the blocks before. Only narrow columns are shuffled; the number of blocks follows the number of rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    blocks = max(8, math.ceil(docs.count() / (shards * rows_a_block)))
    dealt = narrow.withColumn("shard", jump_column(narrow, "doc_id", shards)).withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    totals = dealt.groupBy("shard", "_block").count()
    before = totals.select(
        F.col("shard").alias("_shard"),
        F.col("_block").alias("_in"),
        F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("_place", place)
        .join(before, (F.col("shard") == F.col("_shard")) & (F.col("_block") == F.col("_in")))
        .withColumn("grown_shard", jump_column(narrow, "doc_id", shards + 1))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_place") - 1 + F.col("_before")).cast("bigint").alias("slot"), "grown_shard")
    )
