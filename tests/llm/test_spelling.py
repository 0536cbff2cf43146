"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palaver.llm import spelling

SCHEMA = "doc_id bigint, text string"


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def counts(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode()) & 0xFFFFFFFF
            if h % 97 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            n[word] = n.get(word, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(rows):
    n = counts(rows)
    near = {w: [] for w in n}
    for x, y in itertools.combinations(n, 2):
        if abs(len(x) - len(y)) < 2 and one_edit(x, y):
            near[x].append(y)
            near[y].append(x)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, str(form[w]), root, n[w], len(near[w]), str(n.get(form[w]))))
    return sorted(out)


def got(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def corpus(seed, alphabet, size, lengths):
    """Words of a few letters, so that many are near each other, with counts that differ."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(size)]
    words += [w[:i] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :] for w in rng.choices(words, k=size) for i in [rng.randrange(len(w) + 1)]]
    return [(i, ", ".join(rng.choices(words, weights=[1 + 40 * (k % 9 == 0) for k in range(len(words))], k=300))) for i in range(40)]


@pytest.mark.parametrize("seed, alphabet, size, lengths, limit", [(0, "ab", 60, [5, 6, 7, 8], 4), (1, "abcd", 150, [5, 6, 7], 4096), (2, "aéÿ÷Z", 120, [5, 9, 12], 3), (3, "xyz", 60, [40, 41, 90], 2)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed, alphabet, size, lengths, limit):
    monkeypatch.setattr(spelling, "HELD", 50)
    partitions = spelling.partitions
    monkeypatch.setattr(spelling, "partitions", lambda words: partitions(words, limit, 8))
    rows = corpus(seed, alphabet, size, lengths)
    rows += [rows[0], rows[0], (None, rows[1][1]), (77, None), (78, ""), (79, "1 2 .. no")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"word": F.lit("x"), "n": F.lit(None).cast("int"), "key": F.lit(1)})
    want = plain(rows)
    assert got(spelling.variants(df)) == want
    assert any(x[4] > 1 for x in want) and any(x[1] != "None" for x in want)


def test_chains_ties_and_long_runs(spark):
    long = "ab" * 3000
    rows = [(1, "abcdex " * 3 + "abcdef " * 7 + "abcdeg " * 7 + "abcxeg " * 20 + "abcxegs " * 50), (2, "short " * 2 + "wörter " * 3 + "Wörter " * 3 + "WÖRTER " * 3), (3, f"{long} " * 9 + f"{long}c " * 4 + f"{long[:3000]}x{long[3000:]} " * 3)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got(spelling.variants(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert found["abcdex"].form == "abcdef" and found["abcdex"].root == "abcdef" and found["abcdeg"].root == "abcxegs" and found[long + "c"].form == long


def test_empty_table(spark):
    assert got(spelling.variants(spark.createDataFrame([], SCHEMA))) == []


def test_acceptor_is_minimal_and_pairs_come_once():
    rng = random.Random(4)
    for _ in range(200):
        f = rng.randint(1, 5)
        words = sorted({"".join(rng.choices("abc", k=rng.choice([f, f + 1]))) for _ in range(rng.randint(2, 60))})
        a = spelling.Acceptor(words)
        found = list(a.pairs(f, True))
        assert sorted(found) == sorted((x, y) for x, y in itertools.product(words, words) if len(x) == f and (len(y) == f + 1 or x < y) and one_edit(x, y))
        rights = {}
        for w in words:
            for i in range(len(w) + 1):
                rights[w[:i]] = frozenset(v[i:] for v in words if v[:i] == w[:i])
        assert len(a.arcs) == len(set(rights.values()))
