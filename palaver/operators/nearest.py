"""Exact cosine search over a large set of known vectors, with most of them left out by the triangle inequality.

Some of the known vectors are pivots. Each known vector belongs to the pivot that it is nearest to, and a pivot knows the least and largest angle of those that belong to it. The angle between a query and a pivot
bounds that between the query and all of a pivot's vectors, so pivots that can't hold what is asked for are not opened. Angles, unlike cosines, satisfy the triangle inequality, so nothing is lost.

Queries and known vectors meet in packs of about ``PACK`` vectors a side: a pair of packs is one product of two matrices, and no pair of vectors is a row. What is broadcast is at most ``PIVOTS`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palaver.storage import settled

PIVOTS, PACK = 256, 256
#: Scores are compared as they are reported, with nine decimals; bounds give way by this much.
DECIMALS, SLACK = 9, 1e-8


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def units(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``embedding`` of length one and its number of components ``dim``; those that are null, empty, without length or with null components are left out."""
    norm = F.coalesce(vector_norm(F.col("embedding")), F.lit(0.0))
    return vectors.withColumn("_n", norm).filter("_n > 0").withColumns({"embedding": F.transform("embedding", lambda x: x.cast("double") / F.col("_n")), "dim": F.size("embedding")}).drop("_n")


def choose_pivots(known: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """About as many pivots as the square root of the known vectors, ``most`` at the most, chosen by their hashes."""
    n = known.count()
    rows = known.select(F.xxhash64("embedding").alias("h"), "embedding").distinct().orderBy("h").limit(min(most, int(np.ceil(np.sqrt(n))))).collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def angles(column: pa.Array, pivots: np.ndarray) -> np.ndarray:
    vectors = column.flatten().to_numpy().reshape(len(column), -1)
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def with_pivot(known: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``known`` with the pivot that each belongs to and the angle to it."""
    shared = known.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = angles(batch.column(batch.schema.get_field_index("embedding")), shared.value)
                nearest = found.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(found[np.arange(len(nearest)), nearest])], [*batch.schema.names, "pivot", "angle"])

    return known.mapInArrow(place, f"{known.schema.simpleString()[7:-1]}, pivot int, angle double")


def probes(queries: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, first: bool) -> DataFrame:
    """``queries`` with a row for each ``pivot`` to open, and ``home``, the likeliest. With ``first`` that one alone, else all others that may hold a cosine of ``least`` or more."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, low, high))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, least_angle, most_angle = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = angles(batch.column(batch.schema.get_field_index("embedding")), p)
            nearest = np.maximum(np.maximum(found - most_angle, least_angle - found), 0.0)
            home = np.lexsort((found, nearest), axis=1)[:, 0]
            if first:
                row, pivot = np.arange(len(home)), home
            else:
                least = batch.column(batch.schema.get_field_index("least")).to_numpy()
                opens = np.cos(nearest) >= least[:, None] - SLACK
                opens[np.arange(len(home)), home] &= batch.column(batch.schema.get_field_index("asked")).to_numpy(zero_copy_only=False) == 0
                row, pivot = np.nonzero(opens)
            for at in range(0, len(row), 4096):  # the vector is repeated for each pivot
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row[at : at + 4096])).columns, pa.array(pivot[at : at + 4096], pa.int32())], [*batch.schema.names, "pivot"])

    return queries.mapInArrow(ask, f"{queries.schema.simpleString()[7:-1]}, pivot int")


def packs(vectors: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(pivot, name): about ``PACK`` vectors with ``columns`` in one row. A pivot's vectors are dealt by their hash, so a large one is many rows."""
    sizes = vectors.groupBy("pivot").agg(F.ceil(F.count("*") / PACK).alias("_g"))
    # At most one row a pivot.
    dealt = vectors.join(F.broadcast(sizes), "pivot").withColumn("_pack", F.pmod(F.xxhash64(*columns), F.col("_g")))
    return dealt.groupBy("pivot", "_pack").agg(F.collect_list(F.struct(*columns, "embedding")).alias(name)).drop("_pack")


def scored(queries: DataFrame, known: DataFrame, ids: list[str], best: bool, observed: Observation | None = None) -> DataFrame:
    """(*ids, id, pos, score): the cosines of queries with the known vectors of their pivot; with ``best`` the largest for each query in a pack, the first by pos among equals, else those of ``least`` or more."""
    asked = ids if best else [*ids, "least"]
    pairs = packs(queries, asked, "q").join(packs(known, ["id", "pos"], "c"), "pivot").select("q", "c")
    if observed is not None:
        pairs = pairs.observe(observed, F.sum(F.size("q").cast("bigint") * F.size("c")).alias("pairs"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, c in zip(batch.column(0), batch.column(1), strict=True):
                q, c = q.values, c.values
                x, y = (z.field("embedding").flatten().to_numpy().reshape(len(z), -1) for z in (q, c))
                score = np.round(x @ y.T, DECIMALS)
                pos = c.field("pos").to_numpy(zero_copy_only=False)
                if best:
                    order = np.argsort(pos, kind="stable")
                    row, col = np.arange(len(x)), order[score[:, order].argmax(axis=1)]
                else:
                    row, col = np.nonzero(score >= q.field("least").to_numpy()[:, None])
                taken = [q.field(k).take(pa.array(row)) for k in ids]
                yield pa.RecordBatch.from_arrays([*taken, c.field("id").take(pa.array(col)), c.field("pos").take(pa.array(col)), pa.array(score[row, col])], [*ids, "id", "pos", "score"])

    kinds = [f"{k} {queries.schema[k].dataType.simpleString()}" for k in ids] + [f"id {known.schema['id'].dataType.simpleString()}", f"pos {known.schema['pos'].dataType.simpleString()}", "score double"]
    return pairs.mapInArrow(product, ", ".join(kinds))


def ranges(placed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest angle of what belongs to each pivot; a pivot of nothing is never opened."""
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    for r in placed.groupBy("pivot").agg(F.min("angle").alias("a"), F.max("angle").alias("b")).collect():  # at most a row a pivot
        low[r["pivot"]], high[r["pivot"]] = r["a"], r["b"]
    return low, high


def by_dimension(queries: DataFrame, known: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Queries and known vectors of each number of components that both have; vectors of other lengths have no angle."""
    for r in sorted(known.select("dim").distinct().join(queries.select("dim").distinct(), "dim").collect()):
        yield queries.filter(F.col("dim") == r["dim"]).drop("dim"), known.filter(F.col("dim") == r["dim"]).drop("dim")


def nearest(queries: DataFrame, known: DataFrame, observed: list[Observation] | None = None) -> DataFrame:
    """(q, id, pos, score): for each query (q, embedding, dim) of length one the known vector (id, pos, embedding, dim) of the largest cosine, the first by pos among equals.

    Each query opens its likeliest pivot first; what it finds there is the bound for all others. ``observed`` gets an observation of the pairs scored in each step.
    """
    found = []
    for asked, all_known in by_dimension(queries, known):
        pivots = choose_pivots(all_known)
        placed = settled(with_pivot(all_known, pivots))
        low, high = ranges(placed, len(pivots))
        watch = [Observation(), Observation()] if observed is not None else [None, None]
        first = settled(scored(probes(asked, pivots, low, high, True), placed, ["q"], True, watch[0]))
        bound = first.groupBy("q").agg(F.max("score").alias("least"))
        more = probes(asked.join(bound, "q").withColumn("asked", F.lit(1)), pivots, low, high, False)
        rest = settled(scored(more, placed, ["q"], True, watch[1]))
        if observed is not None:
            observed.extend(watch)
        found += [first, rest]
    if not found:
        return queries.limit(0).select("q").join(known.limit(0).select("id", "pos", F.lit(0.0).alias("score")), F.lit(True))
    both = found[0]
    for df in found[1:]:
        both = both.unionByName(df)
    top = both.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("less"), "pos", "id")).alias("m"))
    return top.select("q", F.col("m.id").alias("id"), F.col("m.pos").alias("pos"), (-F.col("m.less")).alias("score"))


def within(queries: DataFrame, known: DataFrame, ids: list[str], least: float) -> DataFrame:
    """(*ids, id, pos, score): all pairs of vectors of length one whose cosine is ``least`` or more; only pivots that may hold one are opened."""
    found = None
    for asked, all_known in by_dimension(queries, known):
        pivots = choose_pivots(all_known)
        placed = settled(with_pivot(all_known, pivots))
        low, high = ranges(placed, len(pivots))
        part = scored(probes(asked.withColumns({"least": F.lit(float(least)), "asked": F.lit(0)}), pivots, low, high, False), placed, ids, False)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.limit(0).select(*ids).join(known.limit(0).select("id", "pos", F.lit(0.0).alias("score")), F.lit(True))
    return found
