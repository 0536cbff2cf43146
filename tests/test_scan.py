"""Running values, look-ups and chains by blocks against plain loops; chunking against the fold that it replaces."""

import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import scan, sequence

SEG = "call_id string, pos int, start double, end double, text string, speaker string"


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.choice([None, rng.randint(-5, 5)])) for k in ("a", "b", None) for p in rng.sample(range(-50, 200), 40)]
    got = scan.running(spark.createDataFrame(rows, "k string, p int, v int"), "k", "p", {"s": F.coalesce("v", F.lit(0))}, {"m": F.col("v")}, {"b": F.col("v")}, block=16).collect()
    assert len(got) == len(rows)
    for r in got:
        upto = sorted((p, v) for k, p, v in rows if k == r.k and p <= r.p)
        known = [v for _, v in upto if v is not None]
        assert r.s == sum(known) and r.m == max(known, default=None) and r.b == (upto[-2][1] if len(upto) > 1 else None)


@pytest.mark.parametrize("strict", [False, True])
def test_first_reaching(spark, strict):
    rng = random.Random(2)
    rows, queries = [], [(k, i, float(rng.randint(-5, 120))) for k in "abc" for i in range(40)]
    for k in "ab":
        rows += [(k, float(v), p) for p, v in enumerate(sorted(rng.randint(0, 100) for _ in range(30)))]
    got = scan.first_reaching(spark.createDataFrame(rows, "k string, v double, to int"), spark.createDataFrame(queries, "k string, q int, x double"), "k", 7.0, strict).collect()
    want = {(k, q): min((p for n, v, p in rows if n == k and (v > x if strict else v >= x)), default=None) for k, q, x in queries}
    assert {(r.k, r.q): r.to for r in got} == want and len(got) == len(queries)


def test_chain(spark):
    pointers = [("a", i, i + 1 + i % 3) for i in range(300)] + [("b", 5, 9), ("b", 7, 9)]
    got = scan.chain(spark.createDataFrame(pointers, "k string, at int, to int"), spark.createDataFrame([("a", 0), ("b", 5), ("c", 1)], "k string, at int"), "k").collect()
    want, at, hop = [("b", 5, 0), ("b", 9, 1), ("c", 1, 0)], 0, 0
    while at < 300:
        want.append(("a", at, hop))
        at, hop = at + 1 + at % 3, hop + 1
    assert sorted(tuple(r) for r in got) == sorted([*want, ("a", at, hop)])


def fold(rows, target_minutes, max_chars, min_pause):
    """Chunks of one call, segment by segment."""
    target = target_minutes * 60
    starts, ends, sizes = [r[2] or 0.0 for r in rows], [r[3] or 0.0 for r in rows], [len(r[4] or "") for r in rows]
    if ends[-1] - starts[0] < 1.5 * target and sum(sizes) < max_chars:
        return [0] * len(rows)
    splits = [(a + b) / 2 for a, b in zip(ends, starts[1:]) if b - a >= min_pause]
    if not splits:
        splits = [starts[0] + target * k for k in range(1, 10_000) if starts[0] + target * k < ends[-1]]
    out, chunk, opened, chars = [], 0, starts[0], 0
    for i, (a, e, n) in enumerate(zip(starts, ends, sizes)):
        due = e - opened >= target and any(opened < s <= a for s in splits)
        if i and (due or chars + n > max_chars):
            chunk, opened, chars = chunk + 1, a, 0
        out.append(chunk)
        chars += n
    return out


def calls(seed, n, gaps, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        t = rng.random() * 50
        for p in range(rng.randint(1, 120)):
            t += rng.choice(gaps)
            rows.append((f"c{c}", 3 * p + c, t, t + rng.random() * rng.choice([1, 5, longest]), None if rng.random() < 0.05 else "x" * rng.randint(0, 30), "S"))
    return rows


@pytest.mark.parametrize(
    "gaps, longest, limits",
    [
        ([0, 1, 2, 7], 4, {"target_minutes": 0.5, "max_chars": 10_000, "min_pause": 3.0}),
        ([0, 1, 2, 7], 90, {"target_minutes": 0.5, "max_chars": 300, "min_pause": 0.5}),
        ([0, 1, 2], 20, {"target_minutes": 0.25, "max_chars": 400, "min_pause": 1e9}),
        ([1, 30], 200, {"target_minutes": 1.0, "max_chars": 100_000, "min_pause": 2.0}),
        ([0, 1], 5, {"target_minutes": 1e6, "max_chars": 25, "min_pause": 3.0}),
    ],
)
def test_chunks_are_those_of_a_fold(spark, monkeypatch, gaps, longest, limits):
    monkeypatch.setattr(scan, "BLOCK", 16)
    rows = calls(7, 12, gaps, longest)
    got = {(r.call_id, r.pos): r.chunk_id for r in sequence.chunk_ids(spark.createDataFrame(rows, SEG).repartition(4), **limits).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        want |= {(c, r[1]): k for r, k in zip(mine, fold(mine, **limits))}
    assert got == want and max(want.values()) > 3


def test_chunking_needs_no_python(spark):
    plan = sequence.chunk_ids(spark.createDataFrame(calls(1, 2, [1], 3), SEG), 0.2, 100)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_rate_schedule(spark):
    rng = random.Random(8)
    rows = [(k, float(rng.randint(0, 400)), i) for k in ("a", "b") for i in range(150)]
    got = sequence.rate_schedule(spark.createDataFrame(rows, "k string, t double, i int"), "k", "t", "i", most=7, window=20.0, margin=0.5, block=50.0).collect()
    for k in "ab":
        granted = []
        for _, t, i in sorted(r for r in rows if r[0] == k):
            granted.append(max(t, granted[-7] + 20.5) if len(granted) >= 7 else t)
            (r,) = [r for r in got if (r.k, r.i) == (k, i)]
            assert abs(r.granted - granted[-1]) < 1e-6 and abs(r.wait - (granted[-1] - t)) < 1e-6
    assert max(r.wait for r in got) > 10


def test_energy_of_whole_recordings(spark):
    from palaver.operators import quality

    rng = random.Random(3)
    audio = [(f"c{i}", [rng.gauss(0, 0.1) for _ in range(n)]) for i, n in enumerate([1, 7, 8, 9, 40])]
    segments = [(c, p, a, b) for c, _ in audio for p, (a, b) in enumerate([(0.0, 99.0), (0.5, 1.0), (0.0, 2.0), (1.9, 2.1), (3.0, 2.0), (-1.0, 1.0)])] + [("gone", 0, 0.0, 1.0)]
    df = spark.createDataFrame(audio, "call_id string, samples array<double>")
    recordings = df.select("call_id", F.lit(4).alias("rate"), F.size("samples").alias("samples"), F.lit(None).cast("bigint").alias("bytes"))
    got = quality.recording_energy(recordings, quality.sample_blocks(df, 4), spark.createDataFrame(segments, "call_id string, pos int, start double, end double"), 4, least=0.1, max_seconds=9.0).collect()
    known = dict(audio)
    assert len(got) == len(segments)
    for r in got:
        x = known.get(r.call_id)
        (a, b) = next((a, b) for c, p, a, b in segments if (c, p) == (r.call_id, r.pos))
        part = [] if x is None else x[max(0, int(a * 4 // 1)) : max(0, int(b * 4 // 1))]
        if x is None or len(x) / 4 > 9.0:
            assert (r.rms, r.low_energy) == (None, False)
        elif not part:
            assert (r.rms, r.low_energy) == (None, True)
        else:
            rms = (sum(v * v for v in part) / len(part)) ** 0.5
            assert r.rms == pytest.approx(rms, abs=1e-9) and r.low_energy == (round(rms, 9) < 0.1)


def test_summary(spark):
    from palaver.operators import summary

    text = "The red fox runs. A red fox and a dog run! Nothing else here? The dog runs after the red fox.  Zebra."
    docs = spark.createDataFrame([("a", text), ("b", "One."), ("c", " "), ("d", None), ("e", "!? ...")], "call_id string, text string")
    got = {r.call_id: (r.summary, list(r.sentences)) for r in summary.extractive_summary(docs, most=2).collect()}
    assert set(got) == {"a", "b", "e"} and got["b"] == ("One.", [0]) and 3 in got["a"][1] and 4 not in got["a"][1]
    scores = summary.ranked_sentences(docs, "call_id", "text", tolerance=1e-9, rounds=60).filter("call_id = 'a'").orderBy("pos").collect()
    words = [{"the", "red", "fox", "runs"}, {"a", "red", "fox", "and", "dog", "run"}, {"nothing", "else", "here"}, {"the", "dog", "runs", "after", "red", "fox"}, {"zebra"}]
    like = [[len(x & y) / (len(x) * len(y)) ** 0.5 if x is not y else 0 for y in words] for x in words]
    rank = [0.2] * 5
    for _ in range(60):
        rank = [0.03 + 0.85 * sum(like[j][i] / sum(like[j]) * rank[j] for j in range(5) if sum(like[j])) for i in range(5)]
    assert [r.score for r in scores] == pytest.approx(rank, abs=1e-6)


def test_texts_are_ranked_where_they_lie(spark):
    """nothing is shuffled or stored for the ranks, and texts that are ranked together do not mix."""
    from palaver.operators import summary

    rng = random.Random(5)
    rows = [(i, " ".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) + "." for _ in range(rng.randint(0, 9)))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, None)], "call_id int, text string").coalesce(1)
    ranked = summary.ranked_sentences(docs, "call_id", "text", rounds=6, tolerance=0.0)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[call_id", "")
    got = {}
    for r in ranked.orderBy("call_id", "pos").collect():
        got.setdefault(r.call_id, []).append(r.score)
    for i, text in rows:
        sets = [set(x.split()) for x in text.rstrip(".").split(". ")] if text else []
        like = [[len(x & y) / (len(x) * len(y)) ** 0.5 if a != b else 0 for b, y in enumerate(sets)] for a, x in enumerate(sets)]
        rank = [1 / len(sets)] * len(sets) if sets else []
        for _ in range(6):
            rank = [0.15 / len(sets) + 0.85 * sum(like[j][k] / sum(like[j]) * rank[j] for j in range(len(sets)) if sum(like[j])) for k in range(len(sets))]
        assert got.get(i, []) == pytest.approx(rank, abs=1e-9)
