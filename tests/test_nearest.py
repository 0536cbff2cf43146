"""Pruned cosine search, greedy assignment by rounds and long chains of merges against plain versions."""

import random

import numpy as np
import pytest

from palaver.operators import identity, metrics, nearest

CAND = "candidate_id string, pos int, embedding array<double>"


def plain_best(queries, candidates, threshold):
    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b) if a and b and len(a) == len(b) else 0
        return round(float(np.dot(a, b) / n), 9) + 0.0 if n else 0.0

    out = {}
    for q, v in queries:
        best = min(((-cosine(v, c), p, i) for i, p, c in candidates), default=None)
        out[q] = (None, 0.0) if best is None else (best[2] if -best[0] >= threshold else None, -best[0] + 0.0)
    return out


@pytest.mark.parametrize("seed, n, spread", [(0, 300, 0.05), (1, 40, 1.0), (2, 3, 1.0), (3, 0, 1.0)])
def test_best_match(spark, monkeypatch, seed, n, spread):
    monkeypatch.setattr(nearest, "PACK", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    draw = lambda: (centres[rng.integers(12)] + spread * rng.normal(size=8)).tolist()
    cands = [(f"c{i}", int(p), draw()) for i, p in enumerate(rng.permutation(n))]
    if n > 3:
        cands += [("again", 1000, cands[0][2]), ("scaled", -5, [3 * x for x in cands[1][2]]), ("zero", 500, [0.0] * 8), ("none", 501, None), ("short", 502, [1.0, 2.0])]
    queries = [(i, draw()) for i in range(150)] + [(900, [-x for x in cands[0][2]] if cands else [1.0]), (901, [0.0] * 8), (902, None), (903, []), (904, [2.0, 1.0]), (905, [1.0] * 5)]
    seen = []
    got = identity.best_match(spark.createDataFrame(queries, "query_id int, embedding array<double>").repartition(3), spark.createDataFrame(cands, CAND).repartition(3), 0.5, seen)
    found = {r.query_id: (r.match_id, round(r.score, 6)) for r in got.collect()}
    assert found == {q: (i, round(s, 6)) for q, (i, s) in plain_best(queries, cands, 0.5).items()}
    if spread < 0.1:
        assert sum(o.get["pairs"] or 0 for o in seen) < 0.35 * 150 * n  # most pairs are not scored


def test_all_scores(spark):
    rng = np.random.default_rng(4)
    known = [(f"n{i}", rng.normal(size=6).tolist()) for i in range(60)]
    vectors = [(i % 5, f"l{i}", rng.normal(size=6).tolist()) for i in range(80)]
    got = identity.all_scores(spark.createDataFrame(vectors, "call_id int, label string, embedding array<double>"), spark.createDataFrame(known, "name string, embedding array<double>"), 0.4).collect()
    cos = {(c, a, b): np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) for c, a, x in vectors for b, y in known}
    assert {(r.call_id, r.label, r.name): round(r.score, 6) for r in got} == {k: round(float(s), 6) for k, s in cos.items() if round(float(s), 9) >= 0.4}


def test_greedy_rounds_equal_the_fold(spark):
    rng = random.Random(5)
    rows = [(c, f"l{a}", f"n{b}", rng.choice([0.3, 0.5, 0.7, rng.random()])) for c in range(6) for a in range(9) for b in range(9) if rng.random() < 0.8]
    rows += [rows[0], (0, None, "n1", 0.9), (0, "l1", None, 0.9)]
    got = identity.greedy_assignment(spark.createDataFrame(rows, "call_id int, label string, name string, score double"), 0.35).collect()
    want, used = [], set()
    for c, a, b, s in sorted((r for r in set(rows) if r[1] and r[2]), key=lambda r: (r[0], -r[3], r[1], r[2])):
        if s >= 0.35 and (c, "l", a) not in used and (c, "n", b) not in used:
            used |= {(c, "l", a), (c, "n", b)}
            want.append((c, a, b, s))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_long_chains_of_merges(spark):
    ids = spark.createDataFrame([(f"k{i}",) for i in range(200)], "speaker_cluster_id string")
    chain = [(f"k{i}", f"k{i + 1}") for i in range(150)] + [("k199", "k150"), ("k180", "gone")]
    got = identity.final_targets(ids, spark.createDataFrame(chain, "source string, target string")).collect()
    assert {r._s: r._t for r in got} == {f"k{i}": "k150" for i in [*range(150), 199]}
    for bad in ([("k1", "k2"), ("k2", "k1")], [("k1", "k1")]):
        with pytest.raises(Exception, match="circle|itself"):
            identity.final_targets(ids, spark.createDataFrame(bad, "source string, target string")).collect()


def test_diarization_error_by_bins(spark):
    rng = random.Random(6)
    turns = lambda names: [("c", a, a + rng.random() * 30, rng.choice(names)) for a in (rng.random() * 300 for _ in range(60))]
    ref, hyp = (spark.createDataFrame(turns(n), "call_id string, start double, end double, speaker string") for n in ("ABCD", "xyz"))
    found = [metrics.diarization_error(ref, hyp, 0.3, width).first() for width in (7.0, 1e6)]
    assert [round(x, 6) for x in found[0][1:]] == [round(x, 6) for x in found[1][1:]] and 0 < found[0].confusion < found[0].total


def test_diarization_tasks_grow_with_the_turns(spark, monkeypatch):
    """F8: one shuffle by call and bin, to as many tasks as the number of turns asks for, and the same error as with few tasks."""
    rng = random.Random(4)
    some = lambda: [(i % 7, i, a, a + rng.randint(0, 40), rng.choice("xyz")) for i in range(300) for a in [float(rng.randint(0, 300))]]
    ref, hyp = (spark.createDataFrame(some(), "call_id int, pos int, start double, end double, speaker string") for _ in range(2))
    few = sorted(map(tuple, metrics.diarization_error(ref, hyp, width=50.0).collect()))
    monkeypatch.setattr(metrics, "TURNS", 20)
    many = metrics.diarization_error(ref, hyp, width=50.0)
    plan = many._jdf.queryExecution().executedPlan().toString()
    n = ref.union(hyp).filter("end > start").count()
    assert f", {-(-n // 20)})" in plan and plan.count("_bin#") and not [line for line in plan.splitlines() if "Exchange" in line and "_bin#" in line and "REPARTITION_BY_NUM" not in line]
    assert [r[0] for r in few] == list(range(7)) and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(few, sorted(map(tuple, many.collect())), strict=True))
