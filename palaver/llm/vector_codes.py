"""Operator 13: compression of vectors to codes of 16 bytes by trained codebooks (product quantization in integers).

Components become ``floor(SCALE x)``; a vector is cut into ``PARTS`` equal parts, and each part is replaced by the nearest of its position's ``ENTRIES``
entries. All sums and distances are whole numbers, so the result is the same however Spark deals the rows.

Nearest entries are found by memoised grid cells: a part falls into a coarse cell, a box of the grid with sides of a power of two. An entry
whose least distance to the box is more than the largest distance of another one is nearest to no point of the box. The entries
that are left are worked out once for each cell that occurs and kept; only these are measured for the parts inside.

What is broadcast is the codebooks, whose size does not depend on the rows. A task adds up its parts by entry before anything is shuffled.

Defined cases: rows whose vector is null or has null or non-finite components are dropped, and so are those whose length is not the one of the first
vector (by id) that has a positive multiple of ``PARTS`` components. Repeated ids are rows like others, and take part in the first entries by their
components; a null id comes after all others. With fewer than ``ENTRIES`` rows there are as many entries as rows. Equal distances take the lower
index. Rows with a null label are one group. Other columns, whatever their names, are ignored, as are texts; an empty table gives no rows. Components must be less
than 2**20 in size, so that sums of squares fit; larger ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import join_split, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Cells along the extent of a codebook, cells that a task remembers at once, and rows that it looks at together.
CELLS, MEMORY, ROWS = 8, 1 << 16, 4096
LARGEST = 1 << 20


class Cells:
    """Entries of one codebook that can be nearest inside a grid cell, worked out once for each cell."""

    def __init__(self, book: np.ndarray):
        self.book = book
        extent = int(np.max(book.max(axis=0) - book.min(axis=0))) if book.size else 0
        self.shift = max(0, (extent // CELLS).bit_length())
        self.known: dict[bytes, np.ndarray] = {}

    def entries(self, cell: np.ndarray) -> np.ndarray:
        """Ascending indexes of the entries that no other entry beats everywhere in the box."""
        if (found := self.known.get(cell.tobytes())) is None:
            low = cell << self.shift
            high = low + (1 << self.shift) - 1
            nearest = np.maximum(np.maximum(low - self.book, self.book - high), 0)
            farthest = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
            least, most = (nearest**2).sum(axis=1), (farthest**2).sum(axis=1)
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[cell.tobytes()] = np.flatnonzero(least <= most.min())
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each of the rows of ``parts``."""
        cells, inside = np.unique(parts >> self.shift, axis=0, return_inverse=True)
        chosen = [self.entries(c) for c in np.ascontiguousarray(cells)]
        sizes = np.array([len(c) for c in chosen])
        begins = np.cumsum(sizes) - sizes
        inside = inside.reshape(-1)
        each = sizes[inside]  # entries to measure for each part
        start = np.cumsum(each) - each
        entry = np.concatenate(chosen)[np.arange(each.sum()) - np.repeat(start - begins[inside], each)]
        distance = ((np.repeat(parts, each, axis=0) - self.book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, start)
        # Entries ascend within a part, so the first that has the least distance is the one with the lower index.
        hit = np.flatnonzero(distance == np.repeat(least, each))
        first = np.searchsorted(hit, start)
        return entry[hit[first]], least


def whole(vector: Column, size: int | None = None) -> Column:
    """Whether a vector is kept: no null or non-finite component, and ``size`` components or else a positive multiple of ``PARTS``."""
    fits = F.size(vector) == size if size else (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fits & finite


def grid(vector: Column) -> Column:
    """Components as whole numbers."""
    large = F.exists(vector, lambda x: F.abs(x) >= LARGEST)
    return F.when(large, F.raise_error(F.lit(f"components must be less than {LARGEST} in size"))).otherwise(F.transform(vector, lambda x: F.floor(x * SCALE).cast("bigint")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, PARTS, width)


def train(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: entries become the floored mean of the parts that they are nearest to."""
    shape = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in shared.value]
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            parts = matrix(batch.column(0), shape[2])
            for p, known in enumerate(cells):
                entry, _ = known.nearest(parts[:, p])
                np.add.at(sums[p], entry, parts[:, p])
                counts[p] += np.bincount(entry, minlength=shape[1])
        p, e = np.nonzero(counts)
        width = np.arange(shape[2])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(width))) for x in (p, e)] + [pa.array(np.tile(width, len(p))), pa.array(sums[p, e].reshape(-1)), pa.array(np.repeat(counts[p, e], len(width)))], ["part", "entry", "i", "s", "n"])

    # At most PARTS x ENTRIES x width rows come to the driver, whatever the table.
    total = rows.select("v").mapInArrow(add, "part bigint, entry bigint, i bigint, s bigint, n bigint").groupBy("part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    part, entry, i, s, n = (c.to_numpy() for c in total.columns)
    after = books.copy()
    after[part, entry, i] = s // n  # floors
    return after


def encoded(rows: DataFrame, books: np.ndarray, id_col: str, label_col: str) -> DataFrame:
    """Rows with ``code`` and ``error``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, label_col)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in shared.value]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            parts = matrix(batch.column(2), books.shape[2])
            found = [known.nearest(parts[:, p]) for p, known in enumerate(cells)]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([codes[at : at + 2 * PARTS] for at in range(0, len(codes), 2 * PARTS)]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select(id_col, label_col, "v").mapInArrow(encode, f"vec_id {kinds[id_col]}, label {kinds[label_col]}, code string, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector, with its label."""
    spark = vectors.sparkSession
    narrow = vectors.select(id_col, label_col, F.col(vector_col).alias("_v"))
    order = [F.col(id_col).asc_nulls_last(), "v"]
    one = narrow.filter(whole(F.col("_v"))).select(id_col, grid(F.col("_v")).alias("v")).orderBy(*order).limit(1).collect()
    size = len(one[0]["v"]) if one else PARTS
    rows = narrow.filter(whole(F.col("_v"), size)).select(id_col, label_col, grid(F.col("_v")).alias("v"))
    first = [r["v"] for r in rows.select(id_col, "v").orderBy(*order).limit(ENTRIES).collect()]
    books = np.array(first, np.int64).reshape(len(first), PARTS, -1 if first else 1).transpose(1, 0, 2).copy()
    if first:
        for _ in range(rounds):
            books = train(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = stored(encoded(rows, books, id_col, label_col), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_split(coded, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")


#: The same by brute force: every part against every entry, with no cells. Codebooks of each round are tables of their own.
SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v, len(embedding) // 16 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM kept, (SELECT unnest(range(16)) AS p)
), ranked AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN ranked USING (vec_id) WHERE e < 64)
{rounds}, last AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part JOIN book2 USING (p)) GROUP BY ALL
), coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM coded JOIN kept USING (vec_id), digest
""".replace(
    "{rounds}",
    "".join(
        f""", near{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e FROM (SELECT vec_id, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part JOIN book{k} USING (p)) GROUP BY ALL
), mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k} JOIN part USING (vec_id, p)) GROUP BY ALL) GROUP BY ALL
), book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)"""
        for k in range(ROUNDS)
    ),
)
