"""Running sums, maxima and look-ups in the order of a key's rows, without a task that holds a whole key.

The rows of a key are cut into blocks by their place. A window runs inside each block, another over the few totals of the key's blocks, and a join puts
both together; a key with most of the rows is thus many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.storage import settled

#: Extent of a block in the order column.
BLOCK = 4096


def running(rows: DataFrame, key: str, order: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: dict[str, Column] | None = None, block: float = BLOCK, tie: str | None = None) -> DataFrame:
    """``rows`` with running sums and maxima up to each row, and the value of the row before it (null for the first one).

    ``order`` is a number, which no two rows of a key share together with ``tie``; ``block`` is the extent of a block in it.
    """
    kinds = [(name, c, kind) for kind, some in (("sum", sums), ("max", maxima), ("before", before)) for name, c in (some or {}).items()]
    marked = rows.withColumns({"_block": F.floor(F.col(order) / block), **{name: c for name, c, _ in kinds}})
    ranks = [order, tie] if tie else [order]
    whole = {"sum": F.sum, "max": F.max, "before": lambda name: F.max_by(name, F.struct(*ranks))}
    totals = marked.groupBy(key, "_block").agg(*[whole[kind](name).alias(name) for name, _, kind in kinds])
    ahead = Window.partitionBy(key).orderBy("_block")
    upto = ahead.rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda n: F.sum(n).over(upto), "max": lambda n: F.max(n).over(upto), "before": lambda n: F.lag(n).over(ahead)}
    offsets = totals.select(F.col(key).alias("_of"), F.col("_block").alias("_at"), *[over[kind](name).alias(f"_offset_{name}") for name, _, kind in kinds])
    joined = marked.join(offsets, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")), "left")
    inside = Window.partitionBy(key, "_block").orderBy(*ranks)
    sofar = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = {
        "sum": lambda n: F.sum(n).over(sofar) + F.coalesce(f"_offset_{n}", F.lit(0)), "max": lambda n: F.greatest(F.max(n).over(sofar), f"_offset_{n}"),
        "before": lambda n: F.when(F.row_number().over(inside) == 1, F.col(f"_offset_{n}")).otherwise(F.lag(n).over(inside)),
    }
    return joined.select(*rows.columns, *[result[kind](name).alias(name) for name, _, kind in kinds])


def first_reaching(rows: DataFrame, queries: DataFrame, key: str, width: float, strict: bool = False) -> DataFrame:
    """(key, q, to): for each query (key, q, x) the least ``to`` of the rows (key, v, to) of its key with v >= x (v > x if ``strict``), null if there is none.

    ``to`` must not fall as ``v`` grows. Rows and queries meet in bins of ``width``; a bin without such a row is followed by the first row of the bins behind it.
    """
    kind = rows.schema["to"].dataType
    both = rows.select(key, F.col("v").cast("double").alias("x"), "to", F.lit(None).cast(queries.schema["q"].dataType).alias("q"), F.lit(0).alias("asks")).unionByName(
        queries.select(key, F.col("x").cast("double").alias("x"), F.lit(None).cast(kind).alias("to"), "q", F.lit(1).alias("asks"))
    )
    both = both.withColumn("_b", F.floor(F.col("x") / width))
    # From the largest value down; of equal values a query comes after the rows it may take.
    down = Window.partitionBy(key, "_b").orderBy(F.desc("x"), F.desc("asks") if strict else F.asc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_own", F.min("to").over(down)).filter("asks = 1").select(key, "q", "_b", "_own")
    behind = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy(key, "_b").agg(F.min("to").alias("_first")).select(F.col(key).alias("_k"), F.col("_b").alias("_o"), F.min("_first").over(behind).alias("_next"))
    return found.join(bins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_o")), "left").select(key, "q", F.coalesce("_own", "_next").alias("to"))


def chain(pointers: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, at, hop): what is reached from ``starts`` (key, at) along ``pointers`` (key, at, to), with the number of steps.

    Doubles pointers: after n rounds all within 2**n steps are known. Only places that some pointer leads to are carried on. Pointers that do not lead forward are left out.
    """
    reached = settled(starts.select(key, "at", F.lit(0).cast("bigint").alias("hop")))
    places = pointers.select(key, F.col("to").alias("at")).unionByName(starts.select(key, "at")).distinct()
    jump, step = settled(pointers.filter("to > at").join(places, [key, "at"], "left_semi").select(key, "at", "to")), 1
    while True:
        new = settled(reached.join(jump, [key, "at"]).select(key, F.col("to").alias("at"), (F.col("hop") + step).alias("hop")))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        jump = settled(jump.join(jump.select(key, F.col("at").alias("to"), F.col("to").alias("_to")), [key, "to"]).select(key, "at", F.col("_to").alias("to")))
        step *= 2
