"""Codes of vectors against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import common, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label), one part and one entry after the other."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(16)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(16)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        held = [[[] for _ in books[p]] for p in range(16)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                held[p][nearest(p, x)[0]].append(x)
        books = [[[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held[p], books[p], strict=True)] for p in range(16)]
    found = [(i, [nearest(p, x) for p, x in enumerate(cut(v))], label) for i, v, label in kept]
    totals = {}
    for _, n, label in found:
        totals[label] = totals.get(label, 0) + sum(d for _, d in n)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for e, _ in n), sum(d for _, d in n), totals[label], digest) for i, n, label in found)


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("seed, n, width, spread", [(0, 150, 32, 0.4), (1, 40, 16, 0.01), (2, 90, 64, 30.0)])
def test_codes_are_those_of_brute_force(spark, seed, n, width, spread):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(n + 1, rows[3][1], 1), (n + 2, rows[3][1], 1), (3, rows[5][1], 0), (None, rows[7][1], 0)]  # ties, a repeated id, none
    rows += [(n + 3, None, 1), (-5, [None, *rows[0][1][1:]], 1), (-6, [float("nan"), *rows[0][1][1:]], 1), (-7, [*rows[0][1][1:], float("-inf")], None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"code": F.lit("x"), "v": F.lit(1), "part": F.lit(None).cast("int")})
    assert got(vector_codes.compress(df)) == plain(rows)


def test_small_tables(spark):
    assert got(vector_codes.compress(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, [0.5] * 16, None), (2, [], 1), (3, [1.0] * 5, 1), (4, None, 1)]
    assert got(vector_codes.compress(spark.createDataFrame(rows, SCHEMA))) == plain(rows[:1])
    with pytest.raises(Exception, match="less than"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA)).collect()


def test_cells_leave_out_no_nearest_entry():
    rng = np.random.default_rng(5)
    for spread in (3, 40, 4000):
        book, parts = rng.integers(-spread, spread, (64, 4)), rng.integers(-2 * spread, 2 * spread, (3000, 4))
        cells = vector_codes.Cells(book)
        entry, least = cells.nearest(parts)
        distance = ((parts[:, None] - book) ** 2).sum(axis=2)
        assert (entry == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
        assert np.mean([len(x) for x in cells.known.values()]) < 40  # entries are left out


def test_join_split(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else (7 if i % 3 == 1 else i)) for i in range(600)], "a int, k int")
    right = spark.createDataFrame([(None, "none"), (7, "seven"), (8, "eight")], "k int, b string")
    joined = common.join_split(left, right, "k", "left", often=10)
    want = {None: "none", 7: "seven", 8: "eight"}
    assert sorted((r.a, r.b) for r in joined.collect()) == [(i, want.get(None if i % 3 == 0 else (7 if i % 3 == 1 else i))) for i in range(600)]
    assert joined.columns == ["a", "k", "b"] and common.join_split(left, right, "k", often=10).count() == 401
