"""Literal cases for operators: boundaries, ties and orders worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palaver.functions import scalars as X
from palaver.operators import analysis, hints, identity, intervals, manifest, metrics, quality, render, reports, rules, sequence
from palaver.plans import pipeline

TURN = "call_id string, pos int, start double, end double, speaker string"
SEG = "call_id string, pos int, start double, end double, text string, speaker string"


def turns(spark, *rows):
    return spark.createDataFrame([("c", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], TURN)


def segs(spark, rows, schema="call_id string, pos int, start double, end double"):
    return spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(rows)], schema)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize("width", [1.0, 3600.0])
def test_majority(spark, width):
    t = turns(spark, (0, 5, "S0"), (5, 10, "S1"))
    got = intervals.majority_speaker(segs(spark, [(1, 4), (6, 9), (2, 7), (0, 10), (20, 25)]), t, width)
    assert [r.speaker for r in got.orderBy("pos").collect()] == ["S0", "S1", "S0", "S0", "UNKNOWN"]


def test_bins_change_nothing(spark):
    rng = random.Random(2)
    s = segs(spark, [(a, a + rng.random() * 30) for a in (rng.random() * 100 for _ in range(40))])
    t = turns(spark, *[(a, a + rng.random() * 40, f"S{rng.randint(0, 3)}") for a in (rng.random() * 100 for _ in range(40))])
    rows = [sorted((r.pos, r.speaker) for r in intervals.majority_speaker(s, t, w).collect()) for w in (0.7, 7.0, 1e6)]
    stats = [intervals.overlap_stats(t, w).first() for w in (0.7, 1e6)]
    assert rows[0] == rows[1] == rows[2] and math.isclose(stats[0].overlap, stats[1].overlap, abs_tol=1e-9)


def test_segments_of_no_length(spark):
    """they lie inside of a turn, at its border or beside it."""
    t = turns(spark, (0, 5, "A"), (5, 10, "B"), (20, 20, "C"))
    got = intervals.majority_speaker(segs(spark, [(3, 3), (5, 5), (12, 12), (15, 25)]), t)
    assert [r.speaker for r in got.orderBy("pos").collect()] == ["A", "UNKNOWN", "UNKNOWN", "C"]
    s = spark.sql("SELECT 'c' call_id, 0 pos, 3D start, 3D end, array(named_struct('word', 'x', 'start', 3D, 'end', 3D, 'probability', 1D, 'speaker', '')) words")
    assert intervals.word_speakers(s, t).first().words[0].speaker == "A"


def test_clocks_of_a_hundred_hours(spark):
    """no digit is cut off, and times before zero are as printf has them."""
    L = F.lit
    assert one(spark, X.clock(L(360000.0)), X.clock(L(359999.0)), X.minutes_clock(L(360000.0)), X.human_duration(L(360061.0)), X.clock(L(-5.0)), X.minutes_clock(L(-65.0)), X.human_duration(L(-65.0))) == ("100:00:00", "99:59:59", "6000:00", "100h 1m 1s", "00:-5", "-1:-5", "-65s")
    rows = spark.createDataFrame([("c", 0, 360000.0, 3600001.5, "x", None)], SEG)
    assert "100:00:00,000 --> 1000:00:01,500" in render.subtitles(rows).first().document


def test_range_and_midpoint(spark):
    t = turns(spark, (0, 5, "S0"), (4.95, 10, "S1"))
    got = intervals.speakers_in_range(segs(spark, [(0, 5), (0, 9)]), t).orderBy("pos").collect()
    assert [(r.speakers, r.is_overlap) for r in got] == [(["S0"], False), (["S0", "S1"], True)]
    t = turns(spark, (0, 5, "A"), (5, 10, "B"))
    assert [r.speaker for r in intervals.midpoint_speaker(segs(spark, [(4, 6), (11, 12)]), t).orderBy("pos").collect()] == ["A", None]


def test_words_keep_their_order(spark):
    s = spark.sql("SELECT 'c' call_id, 0 pos, 0D start, 9D end, array(named_struct('word', 'x', 'start', 0D, 'end', 1D, 'probability', 1D, 'speaker', ''), named_struct('word', 'y', 'start', 6D, 'end', 7D, 'probability', 1D, 'speaker', '')) words")
    got = intervals.word_speakers(s, turns(spark, (0, 5, "A"), (5, 10, "B"))).first()
    assert [(w.word, w.speaker) for w in got.words] == [("x", "A"), ("y", "B")]


def test_overlap_statistics(spark):
    got = intervals.overlap_stats(turns(spark, (0, 6, "A"), (4, 10, "B"))).first()
    assert tuple(got)[1:] == (2.0, 12.0, 10.0, 20.0)


@pytest.mark.parametrize("few", [0, 5000])
def test_crowded_calendar(spark, monkeypatch, few):
    """events that others outdo are left out before they meet calls, and none that wins is; times are coarse, so many overlaps are equal."""
    monkeypatch.setattr(intervals, "FEW", few)
    monkeypatch.setattr(intervals, "STAIRS", 50)
    rng = random.Random(few)
    some = lambda n: [(i, rng.randint(0, 1), 60.0 * (a := rng.randint(0, 300)), 60.0 * (a + rng.randint(0, 90))) for i in range(n)]
    calls, events = some(60), [(i, o, a, b, rng.randint(0, 200)) for i, o, a, b in some(400)]
    c = spark.createDataFrame(calls, "call_id int, owner int, start double, end double")
    e = spark.createDataFrame(events, "event_id int, owner int, start double, end double, pos int").repartition(4)
    for mine in (True, False):
        want = {}
        for k, o, c0, c1 in calls:
            met = [(min(c1, e1) - max(c0, e0), -pos, i) for i, p, e0, e1, pos in events if (not mine or o == p) and min(c1, e1) - max(c0, e0) >= 60]
            if met:
                want[k] = (max(met)[2], max(met)[0])
        found = intervals.calendar_match(c if mine else c.drop("owner"), e if mine else e.drop("owner"))
        assert {r.call_id: (r.event_id, r.seconds) for r in found.collect()} == want
    crowd = spark.range(3000).selectExpr("0 owner", "id * 1D e0", "id + 100D - id % 90 e1", "id e_pos", "id event_id").repartition(3)
    assert intervals.matchable(crowd)[1] <= 3000 * 0.1


def test_calendar(spark):
    calls = spark.createDataFrame([("x", 1000.0, 2200.0), ("y", 9000.0, 9030.0)], "call_id string, start double, end double")
    events = spark.createDataFrame([("e1", 0, 1000.0, 2800.0), ("e2", 1, 1000.0, 2800.0), ("e3", 2, 9000.0, 9050.0)], "event_id string, pos int, start double, end double")
    assert [tuple(r) for r in intervals.calendar_match(calls, events).collect()] == [("x", "e1", 1200.0)]


def test_dedup_repetition_and_pauses(spark):
    rows = [("c", i, float(i), i + 1.0, t, None) for i, t in enumerate(["A", " ", "A", "B", "A"])]
    assert [r.pos for r in sequence.consecutive_dedup(spark.createDataFrame(rows, SEG)).orderBy("pos").collect()] == [0, 3, 4]
    rows = [("c", i, 0.0, 1.0, t, None) for i, t in enumerate(["a b c d", "a b c x", "x x x x", "x x x x x", "", "x y", "Été là bas", "été LÀ bas!"])]
    assert [r.repeated for r in sequence.repetition_flags(spark.createDataFrame(rows, SEG)).orderBy("pos").collect()] == [False, False, False, True, False, False, False, True]
    assert [r.split for r in sequence.pause_splits(segs(spark, [(0, 5), (9, 12), (14, 15)])).collect()] == [7.0]


@pytest.mark.parametrize(
    "times,texts,limits,want",
    [
        ([(i, i + 1) for i in range(4)], [6, 5, 4, 9], {"max_chars": 10}, [0, 1, 1, 2]),
        ([(0, 50), (53, 58), (59, 70), (75, 95)], [1] * 4, {"target_minutes": 1.0}, [0, 0, 1, 1]),
        ([(0, 50), (53, 58), (59, 70), (75, 80)], [1] * 4, {"target_minutes": 1.0}, [0, 0, 0, 0]),
    ],
)
def test_chunks(spark, times, texts, limits, want):
    rows = [("c", i, float(a), float(b), "x" * n, "S") for i, ((a, b), n) in enumerate(zip(times, texts))]
    got = sequence.chunk_ids(spark.createDataFrame(rows, SEG), **limits).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == want


def test_sections_and_sessions(spark):
    rows = [("c", i, float(i), i + 0.5, "t", s) for i, s in enumerate(["A", "", "A", "B", None, "A"])]
    assert [r.section for r in sequence.turn_sections(spark.createDataFrame(rows, SEG)).orderBy("pos").collect()] == [1, 1, 1, 2, 2, 3]
    assert [r.session for r in sequence.pause_sessions(segs(spark, [(0, 1), (4, 5), (7, 8)])).orderBy("pos").collect()] == [0, 1, 1]


def test_scalars(spark):
    L = F.lit
    text = "a" * 100 + "QUERY" + "b" * 100
    got = one(spark, X.snippet(L(text), L("query")), X.snippet(L("  abc "), L("zz")), X.first_words(L(" ".join("abcdefghijklmnopqrstuvwxyz"))), X.clock(L(65.0)), X.clock(L(3661.0)), X.human_duration(L(3723.0)), X.human_size(L(500)), X.human_size(L(8448)), X.minutes_clock(L(7500.0)))
    assert got == ("..." + "a" * 80 + "QUERY" + "b" * 80 + "...", "abc", "a b c d e f g h i j k l m n o p q r s t u v w x y...", "01:05", "01:01:01", "1h 2m 3s", "500 B", "8.2 KB", "125:00")
    got = one(spark, X.confidence(L(None).cast("double"), L(-0.5)), X.confidence(L(0.95), L(-9.0)), X.confidence(L(None).cast("double"), L(None).cast("double")), X.confidence(L(None).cast("double"), L(2.0)))
    assert got == (pytest.approx(math.exp(-0.5)), 0.95, None, 1.0)
    v = lambda *x: F.array(*map(L, x))
    assert one(spark, X.cosine(v(1.0, 0.0), v(1.0, 0.0)), X.cosine(v(1.0, 0.0), v(0.0, 1.0)), X.cosine(v(1.0, 0.0), v(-1.0, 0.0)), X.cosine(v(0.0), v(1.0)), X.cosine(v(1.0), v(1.0, 2.0))) == (1.0, 0.0, -1.0, 0.0, 0.0)
    assert one(spark, *[X.band(L(s)) for s in (0.95, 0.92, 0.85, 0.8, 0.65, 0.6, 0.5)]) == ("confirmed", "confirmed", "probable", "probable", "candidate", "candidate", "unknown")
    assert one(spark, X.llm_cost(L(1_000_000), L(100_000), L(3.0), L(15.0)), X.review_priority(L(3600.0), L(10), L(5)), X.review_reason(L(3600.0), L(10)), X.review_priority(L(720.0), L(2), L(2)), X.review_reason(L(720.0), L(2))) == (4.5, 0.5, "frequent_unknown_speaker", 0.2, "high_speaking_time")
    assert one(spark, X.fenced_json(L('```json\n{"a": 1}\n```'), "a int"), X.slug(L("Two Words")), X.number_list(L("0, 0.2,x")), X.truncated(L("abcd"), 3, "#"), X.redacted(L("key=S3"), L("S3"))) == ((1,), "two-words", [0.0, 0.2], "abc#", "key=***")


def test_quality(spark):
    text = "one two three four five six seven eight nine"
    rows = [("c", i, 0.0, 1.0, text, "S", c, None, e) for i, (c, e) in enumerate([(0.9, False), (0.1, False), (0.1, True)])]
    flagged = quality.flag_segments(spark.createDataFrame(rows, f"{SEG}, confidence double, avg_logprob double, low boolean"), energy="low")
    assert [r.risk for r in flagged.orderBy("pos").collect()] == ["none", "medium", "high"]
    assert (quality.apply_filter(flagged, "auto").count(), quality.apply_filter(flagged, "flag").count()) == (2, 3)
    assert tuple(quality.quality_summary(flagged).first())[1:] == (pytest.approx(0.3667, abs=1e-3), 2)
    assert quality.snr_db(__import__("numpy").ones(100), 16000) == 0.0


def test_name_hints(spark):
    said = ["Good, this is Quinn at last.", "Hi Quinn, shall we?", "Thank you Noor, clear to me.", "Well, I am Quinn from Basalt.", "Thanks Friday was fine.", "this is quinn"]
    rows = [("c", i, float(i), i + 1.0, t, f"S{i}") for i, t in enumerate(said)]
    got = hints.routed_hints(hints.name_hints(spark.createDataFrame(rows, SEG))).orderBy("pos", F.desc("confidence")).collect()
    assert [(r.pos, r.name, r.pattern, r.target) for r in got] == [(0, "Quinn", "self_intro", "S0"), (1, "Quinn", "greeting", "addressed_by_S1"), (2, "Noor", "thanks", "addressed_by_S2"), (3, "Quinn", "self_intro_org", "S3")]
    ranked = hints.ranked_hints(hints.name_hints(spark.createDataFrame(rows, SEG))).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4] and [r.confidence for r in ranked] == [0.7, 0.7, 0.5, 0.5]
    names = ["Quinn", "Noor", "Friday", "q", "noor", "42", "Ömer"]
    assert one(spark, *[hints.valid_name(F.lit(n)) for n in names]) == (True, True, False, False, False, False, True)


def test_rules(spark):
    c = lambda k, m: rules.error_category(F.lit(k), F.lit(m))
    got = one(spark, c("RuntimeError", "the CUDA device went away"), c("RuntimeError", "port is BUSY"), c("RuntimeError", "no codec here"), c("OSError", "wrong format"), c("TimeoutError", "invalid"), c("KeyError", ""), c("UnicodeDecodeError", ""), c("ConnectionResetError", "invalid"))
    assert got == ("transient", "transient", "permanent", "permanent", "transient", "permanent", "permanent", "transient")
    assert one(spark, *[rules.exit_code(F.lit(k), F.lit("")) for k in ("JSONDecodeError", "BrokenPipeError", "RecursionError", "KeyError")]) == (3, 1, 1, 4)
    assert one(spark, *[rules.safe_path(F.lit(p)) for p in ("", " ", "a\tb\n", "a\x01", "a/..", "..b", "/a")]) == (False, False, True, False, False, True, False)
    retry = lambda s, n: rules.should_retry(F.lit("transient"), F.lit(s), F.lit(n), F.lit(3))
    assert one(spark, retry("smart", 1), retry("never", 1), retry("always", 3), rules.translate_path(F.lit("D:\\two words\\x")), rules.safe_path(F.lit("a/../b")), rules.safe_path(F.lit("a/b")), rules.backoff_seconds(F.lit(9))) == (True, False, False, "/mnt/d/two words/x", False, True, 10.0)
    assert rules.merged_settings({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    df = spark.sql("SELECT named_struct('file', 'f', 'n', 1, 'list', array(named_struct('x', 1, 'y', 2))) AS results, 5 AS other")
    assert rules.project_fields(df, ["results.file", "results.list.x", "gone", "other.deep"]).first().asDict(True) == {"results": {"file": "f", "list": [{"x": 1}]}}


IDENT = "speaker_cluster_id string, canonical_name string, aliases array<string>, status string, embedding_centroid array<double>, sample_count bigint, first_seen string, last_seen string, total_calls bigint, total_speaking_seconds double, typical_co_speakers array<string>, created_from string, updated_at string"


def people(spark, *rows):
    return spark.createDataFrame([(i, n, [], s, v, k, "a", "b", k, 10.0 * k, co, "auto", "t") for i, n, s, v, k, co in rows], IDENT)


def test_identities(spark):
    db = people(spark, ("x", None, "unknown", [1.0, 0.0], 1, ["y", "z"]), ("y", "Dana", "probable", [0.0, 1.0], 3, ["x"]), ("z", None, "candidate", None, 1, ["x", "y"]))
    merge = spark.createDataFrame([("x", "y")], "source string, target string")
    got = {r.speaker_cluster_id: r for r in identity.merge_clusters(db, merge).collect()}
    assert set(got) == {"y", "z"} and got["y"].embedding_centroid == [0.25, 0.75] and got["y"].sample_count == 4
    assert got["y"].typical_co_speakers == ["z"] and got["z"].typical_co_speakers == ["y"] and got["y"].canonical_name == "Dana" and got["y"].status == "probable"
    with pytest.raises(Exception, match="itself"):
        identity.merge_clusters(db, spark.createDataFrame([("x", "x")], "source string, target string")).collect()
    named = identity.confirm(db, spark.createDataFrame([("y", "Robin")], "speaker_cluster_id string, name string"), "now").filter("speaker_cluster_id = 'y'").first()
    assert (named.canonical_name, named.aliases, named.status) == ("Robin", ["Dana"], "confirmed")
    assert identity.set_status(db, spark.createDataFrame([("x", "probable")], "speaker_cluster_id string, status string")).filter("status = 'probable'").count() == 2
    assert identity.add_aliases(db, spark.createDataFrame([("x", "q")], "speaker_cluster_id string, alias string")).filter("size(aliases) = 1").count() == 1
    assert identity.repoint(db, merge).filter("speaker_cluster_id = 'y'").count() == 2
    assert [r.speaker_cluster_id for r in identity.review_queue(db).collect()] == ["x", "z"]


def test_matching(spark):
    known = spark.createDataFrame([("A", 0, [1.0, 0.0, 0.0]), ("B", 1, [0.0, 1.0, 0.0]), ("C", 2, [1.0, 0.0, 0.0])], "candidate_id string, pos int, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.9, 0.1, 0.0]), (2, [0.5, 0.5, 0.7]), (3, [1.0])], "query_id int, embedding array<double>")
    got = {r.query_id: (r.match_id, round(r.score, 3)) for r in identity.best_match(asked, known, 0.9).collect()}
    assert got == {1: ("A", 0.994), 2: (None, 0.503), 3: (None, 0.0)}
    scores = spark.createDataFrame([(1, "S0", "Alice", 0.99), (1, "S0", "Bob", 0.95), (1, "S1", "Alice", 0.97), (1, "S1", "Bob", 0.91), (2, "S0", "Alice", 0.5)], "call_id int, label string, name string, score double")
    assert sorted((r.label, r.name) for r in identity.greedy_assignment(scores, 0.9).collect()) == [("S0", "Alice"), ("S1", "Bob")]
    mean = identity.centroids(spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0])], "label string, embedding array<double>")).first()
    assert (mean.centroid, mean.sample_count) == ([0.5, 0.5, 0.0], 2)


SPEAKERS = "call_id string, call_order int, local_label string, embedding array<double>, speaking_seconds double"
CALLS = [("c1", 1, "S0", [1.0, 0.0, 0.0], 9.0), ("c1", 1, "S1", [0.0, 1.0, 0.0], 5.0), ("c2", 2, "S0", [0.98, 0.1, 0.0], 3.0), ("c2", 2, "S1", [0.97, 0.1, 0.0], 8.0)]


def resolved(rows):
    got = {(r.call_id, r.local_label): r for r in rows}
    assert len({r.speaker_cluster_id for r in rows}) == 3
    assert got["c2", "S1"].speaker_cluster_id == got["c1", "S0"].speaker_cluster_id and got["c2", "S1"].status == "confirmed"
    assert got["c2", "S0"].source == "auto_cluster"


def test_resolver(spark):
    rows = spark.createDataFrame(CALLS, SPEAKERS)
    resolved(identity.resolve_calls(rows, 0.7).collect())
    r = spark.createDataFrame([(0.4, 0.5, 0.7, "unknown", "db_match"), (0.2, 0.5, 0.7, "confirmed", "db_match"), (0.2, 0.9, 0.9, "unknown", "auto_cluster"), (0.3, 1.0, 1.0, "unknown", "db_match")], "confidence double, calendar_score double, hint_score double, status string, source string")
    assert [(round(x.confidence, 2), x.status, x.source) for x in identity.aggregate_confidence(r).collect()] == [(0.49, "unknown", "db_match"), (0.2, "confirmed", "db_match"), (0.45, "unknown", "auto_cluster"), (0.65, "candidate", "aggregate")]
    n = spark.createDataFrame([("k", "Dana"), ("k", "dana"), ("k", "DANA"), ("j", "Lee"), ("j", "lee"), ("i", "")], "speaker_cluster_id string, name string")
    assert {r.speaker_cluster_id: r.status for r in identity.agreement_status(n).collect()} == {"k": "confirmed", "j": "probable"}


def test_reports(spark):
    calls = spark.createDataFrame([("c", "Budget x")], "call_id string, text string")
    s = spark.createDataFrame([("c", 0, 0.0, 1.0, "Budget x", "Dana")], SEG)
    assert (reports.search(calls, s, "budget").count(), reports.search(calls, s, "budget", "Dana").count(), reports.search(calls, s, "").count()) == (2, 1, 1)
    got = one(spark, reports.other_actions(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b"))))
    assert got == (["a", "a", "b"],)
    log = spark.createDataFrame([("m", 1_000_000, 100_000), ("other", 1_000_000, 0)], "model string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_price double, output_price double")
    rows = reports.cost_rollup(reports.priced(log, prices), F.lit(None).cast("string")).collect()
    assert {(r.kind, r.name): r.cost_usd for r in rows} == {("total", ""): 4.2, ("model", "m"): 1.2, ("model", "other"): 3.0, ("day", "unknown"): 4.2}


def test_manifest(spark):
    done = spark.createDataFrame([("h", "completed", "draft", "1.0")], "hash string, status string, tier string, version string")
    e = spark.createDataFrame([("h",), ("k",), (None,)], "hash string")
    assert [r.hash for r in manifest.diff_against_manifest(e, done, "draft", "1.0").collect()] == ["k"]
    assert manifest.diff_against_manifest(e, done, "balanced", "1.0").count() == 2
    old = spark.createDataFrame([("h", "error", "boom", 1.0)], "hash string, status string, error string, last_updated double")
    new = spark.createDataFrame([("h", "completed", None, 2.0), ("n", "pending", None, 1.0)], old.schema)
    patched = {r.hash: r for r in manifest.patch(old, new).collect()}
    assert (patched["h"].status, patched["h"].error, patched["n"].status) == ("completed", "boom", "pending")
    assert manifest.upsert(old, new).filter("hash = 'h'").first().status == "completed"
    assert {r.status: r.n for r in manifest.status_counts(done).collect()} == {"pending": 0, "transcribed": 0, "completed": 1, "error": 0}


def test_analysis(spark):
    schema = "call_id string, chunk_id int, title string, summary string, classification string, topics array<string>, action_items array<string>, key_decisions array<string>, questions_raised array<string>"
    a = spark.createDataFrame([("c", 0, "", "one", "call", ["Hiring", "budget"], ["x"], [], []), ("c", 2, "T", "two", "other", ["BUDGET", "Ops"], ["y"], ["d"], None), ("s", 0, "S", "z", None, None, [], [], [])], schema)
    got = {r.call_id: r for r in analysis.merge_analyses(a).collect()}
    assert (got["c"].topics, got["c"].title, got["c"].summary, got["c"].classification, got["c"].action_items, got["c"].chunked) == (["Hiring", "budget", "Ops"], "T", "one two", "call", ["x", "y"], True)
    assert (got["s"].classification, got["s"].topics, got["s"].chunked) == (None, None, False)
    s = spark.createDataFrame([("c", 1, 61.0, 62.0, " hi ", None), ("c", 0, 0.0, 1.0, "a", "Dana")], SEG)
    assert analysis.prompt_text(s).first().prompt == "Speakers detected: Dana\n\n" + analysis.UNTRUSTED + "\n[00:00] Dana: a\n[01:01] hi"
    assert analysis.prompt_text(s, 30).first().prompt.endswith("\n\n[TRANSCRIPT TRUNCATED]")


def test_render(spark):
    s = spark.createDataFrame([("c", 0, 0.0, 1.0, "Hi.", "Quinn", 0.9), ("c", 1, 2.0, 3.0, "More.", "Quinn", 0.9), ("c", 2, 65.0, 66.0, "Maybe.", "Noor", 0.2)], f"{SEG}, confidence double")
    body = render.transcript_body(s).first().body
    assert body == "## Transcript\n\n### Quinn — 00:00\n\nHi.\n\nMore.\n\n### Noor — 01:05\n\n[?] Maybe.\n"
    assert render.subtitles(s, "vtt").first().document.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nHi.")
    assert render.rttm_lines(turns(spark, (1.25, 3.25, "L1"))).first().line == "SPEAKER c 1 1.250 2.000 <NA> <NA> L1 <NA> <NA>"


def test_metrics(spark):
    totals = spark.createDataFrame([("c", "A", 10), ("c", "B", 10), ("d", "A", 0), ("d", "B", 10)], "call_id string, speaker string, words bigint")
    assert {r.call_id: r.gini for r in metrics.participation_gini(totals).collect()} == {"c": 0.0, "d": 0.5}
    ref = turns(spark, (0, 10, "A"), (10, 20, "B"))
    same = metrics.diarization_error(ref, turns(spark, (0, 10, "x"), (10, 20, "y"))).first()
    half = metrics.diarization_error(ref, turns(spark, (0, 20, "x")), 0.0).first()
    assert same.der == 0 and half.der == pytest.approx(0.5)
    s = spark.createDataFrame([("c", 0, 0.0, 5.0, "The quarterly budget and revenue agenda", "A"), ("c", 1, 5.0, 6.0, "ok", "B")], SEG)
    assert metrics.classify_meetings(s).first().classification == "business-meeting"


def test_whole_job(spark):
    s = spark.createDataFrame([("c1", 0, 0.0, 4.0, "Hello.", None, None, -0.1), ("c1", 1, 5.0, 8.0, "Goodbye.", None, None, -0.1), ("c1", 2, 8.0, 9.0, "Goodbye.", None, None, -0.1)], f"{SEG}, confidence double, avg_logprob double")
    t = spark.createDataFrame([("c1", 0, 0.0, 4.0, "S0"), ("c1", 1, 4.5, 9.0, "S1")], TURN)
    assert [r.speaker for r in pipeline.enrich(s, t).orderBy("pos").collect()] == ["S0", "S1"]
    vectors = spark.createDataFrame([("c1", "S0", [1.0, 0.0]), ("c1", "S1", [0.0, 1.0])], "call_id string, local_label string, embedding array<double>")
    assert all(r.speaker.startswith("spk_") for r in pipeline.enrich(s, t, vectors).collect())

    def model(parts):
        none = F.array().cast("array<string>")
        return parts.select("call_id", "chunk_id", F.lit("T").alias("title"), F.col("text").alias("summary"), F.lit("call").alias("classification"), none.alias("topics"), none.alias("action_items"), none.alias("key_decisions"), none.alias("questions_raised"))

    assert pipeline.analyze(s, model).first().summary == "Hello. Goodbye. Goodbye."


def test_diarization_maps_more_than_eight_speakers_at_best(spark):
    others = [(30 + k, 31 + k, f"s{k}") for k in range(7)]
    ref = turns(spark, (0, 19, "a"), (20, 29, "b"), *others)
    hyp = turns(spark, (0, 10, "x"), (10, 19, "y"), (20, 29, "x"), *others)
    got = metrics.diarization_error(ref, hyp, 0.0).first()
    assert (got.missed, got.false_alarm, got.confusion, got.total) == (0, 0, 10, 35)  # a is y and b is x; taking a as x first would leave 18
