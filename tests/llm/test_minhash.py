"""Near duplicates by MinHash against all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from palaver.llm import minhash

SCHEMA = "doc_id bigint, text string"


def word_set(text, words=2):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def roots(rows, words=2):
    """The set of each row, and the component that it is in, by all pairs."""
    sets = [word_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def plain(rows, words=2):
    """(doc_id, n, component_id, kept) of all rows; a component of null ids alone has a null id."""
    sets, root = roots(rows, words)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    return sorted((str(doc_id), len(sets[i]), str(least.get(root[i])), doc_id == least.get(root[i])) for i, (doc_id, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return words


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAN", 5)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):  # groups of near copies around the threshold, exact copies and chains
        base = rng.choices(vocabulary, k=rng.choice([3, 20, 60, 200]))
        text = base
        for _ in range(rng.randint(1, 12)):
            text = changed(rng, rng.choice([base, text]), rng.randint(0, max(1, len(base) // 14)))
            rows.append(" ".join(text))
    texts = [*rows, *rows[:9], *(" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(60)), None, "", " \t\n", "One", "ONE", "one  two", "ONE\x0btwo", "one two ", "É a", "é a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [rows[4], rows[4], (None, texts[7]), (None, "of its own null"), (rows[5][0], "other text of the same id")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"node": F.lit(1), "n": F.lit("x"), "_mark": F.lit(None).cast("int")})
    assert got(minhash.near_groups(df)) == plain(rows)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    sets, root = roots(rows)
    assert kept.count() == len({r for s, r in zip(sets, root, strict=True) if s}) + sum(not s for s in sets)


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """A star of near copies: as many verified pairs as nodes, not their square; and pairs below the threshold make none."""
    seen = []
    verified = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(minhash, "TILE", 64)
    made = []
    settle = minhash.settle
    monkeypatch.setattr(minhash, "settle", lambda df: made.append((df.columns, (now := settle(df)).count())) or now)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, rng.randint(0, 3)))) for i in range(400)] + [(1000 + i, " ".join([*base[:50], *(f"y{rng.random()}" for _ in range(120))])) for i in range(400)]
    assert got(minhash.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)
    assert sum(seen) < 600
    # Copies that are changed too much to be near each other.
    seen.clear()
    made.clear()
    rows = [(i, " ".join(changed(rng, base, rng.randint(6, 12)))) for i in range(300)]
    assert got(minhash.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)
    assert sum(seen) < 5 * len(rows) and max(n for columns, n in made if columns[:2] == ["a", "b"]) < 5 * len(rows)


def test_other_shingles(spark):
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(99)], k=90)
    rows = [(i, " ".join(changed(rng, base, i % 4))) for i in range(30)]
    assert got(minhash.near_groups(spark.createDataFrame(rows, SCHEMA), words=5)) == plain(rows, 5)


def test_small_and_long_texts(spark):
    assert got(minhash.near_groups(spark.createDataFrame([], SCHEMA))) == []
    assert minhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " w7 w9"), (3, "a" * 1_000_000), (4, "a" * 1_000_000), (5, None), (6, None)]
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()] == [
        (1, 199_999, 1, True), (2, 200_001, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True),
    ]


def test_bayesian_bounds_keep_pairs_at_the_threshold():
    looks = minhash.fewest_matches()
    assert [n for n, _ in looks] == list(range(32, 257, 32)) and all(m < 0.8 * n for n, m in looks) and looks[-1][1] > 160
    rng = np.random.default_rng(1)
    match = rng.random((20_000, minhash.PROOF)) < 0.8
    keep, m = minhash.survivors(match.astype(np.uint8), np.ones((20_000, minhash.PROOF), np.uint8), looks)
    assert len(keep) == 20_000 and (m == match.sum(axis=1)).all()
    match = rng.random((20_000, minhash.PROOF)) < 0.3
    assert len(minhash.survivors(match.astype(np.uint8), np.ones((20_000, minhash.PROOF), np.uint8), looks)[0]) == 0
    # Shares of equal minimum hashes are the sets' similarity.
    factors = minhash.hash_functions(4000)
    x, y = (minhash.minima(rng.integers(0, 1 << 63, 900, np.uint64), factors) for _ in range(2))
    both = rng.integers(0, 1 << 63, 800, np.uint64)
    p, q = (minhash.minima(np.concatenate([both, rng.integers(0, 1 << 63, 100, np.uint64)]), factors) for _ in range(2))
    assert (x == y).mean() < 0.01 and abs((p == q).mean() - 0.8) < 0.03


def test_steps_of_few_rows_are_read_by_few_tasks(spark):
    few = minhash.settle(spark.range(90).withColumnRenamed("id", "a").repartition(45))
    assert few.rdd.getNumPartitions() < 15 and few.count() == 90
