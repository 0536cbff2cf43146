"""Queries of the time-interval and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.scalars import clock, human_duration, human_size, minutes_clock
from palaver.operators import intervals as I
from palaver.operators import metrics as M
from palaver.operators import sequence as S
from palaver.plans.registry import CHATS, EVENTS, LINES, intervals, lines, query, table, timed_chats

OVERLAP = f"""{EVENTS}, ov AS (SELECT s.call_id, s.pos, t.speaker, sum(least(s.s1, t.s1) - greatest(s.s0, t.s0)) AS d, min(t.pos) AS p
FROM seg s JOIN turn t ON s.call_id = t.call_id AND t.s0 < s.s1 AND t.s1 > s.s0 GROUP BY 1, 2, 3)"""


def _parts(spark, sf_dir):
    every = intervals(spark, sf_dir)
    return every.filter("speaker = 'view'"), every.filter("speaker <> 'view'")


@query("majority_speaker", f"""WITH {OVERLAP}, best AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY call_id, pos ORDER BY round(d, 9) DESC, p) = 1)
SELECT seg.call_id, seg.pos, coalesce(best.speaker, 'UNKNOWN') AS speaker FROM seg LEFT JOIN best ON seg.call_id = best.call_id AND seg.pos = best.pos""")
def majority_speaker(spark, sf_dir):
    segments, turns = _parts(spark, sf_dir)
    return I.majority_speaker(segments, turns).select("call_id", "pos", "speaker")


def _with_words(segments):
    half = (F.col("start") + F.col("end")) / 2
    word = lambda name, a, b: F.struct(F.lit(name).alias("word"), a.alias("start"), b.alias("end"), F.lit(1.0).alias("probability"), F.lit(None).cast("string").alias("speaker"))
    return segments.withColumn("words", F.array(word("first", F.col("start"), half), word("second", half, F.col("end"))))


@query("word_speaker", f"""WITH {EVENTS}, w AS (SELECT call_id, pos, 0 AS w_no, s0, (s0 + s1) / 2 AS s1 FROM seg UNION ALL SELECT call_id, pos, 1, (s0 + s1) / 2, s1 FROM seg),
ov AS (SELECT s.call_id, s.pos, s.w_no, t.speaker, sum(least(s.s1, t.s1) - greatest(s.s0, t.s0)) AS d, min(t.pos) AS p FROM w s JOIN turn t ON s.call_id = t.call_id AND t.s0 < s.s1 AND t.s1 > s.s0 GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY call_id, pos, w_no ORDER BY round(d, 9) DESC, p) = 1)
SELECT w.call_id, w.pos, string_agg(coalesce(best.speaker, 'UNKNOWN'), ',' ORDER BY w.w_no) AS speakers FROM w LEFT JOIN best ON w.call_id = best.call_id AND w.pos = best.pos AND w.w_no = best.w_no GROUP BY 1, 2""")
def word_speaker(spark, sf_dir):
    segments, turns = _parts(spark, sf_dir)
    return I.word_speakers(_with_words(segments), turns).select("call_id", "pos", F.array_join(F.transform("words", lambda w: w["speaker"]), ",").alias("speakers"))


@query("speakers_in_range", f"""WITH {OVERLAP}, listed AS (SELECT call_id, pos, string_agg(speaker, ',' ORDER BY round(d, 9) DESC, p) AS speakers, count(*) AS n FROM ov WHERE round(d, 9) >= 0.1 GROUP BY 1, 2)
SELECT seg.call_id, seg.pos, coalesce(speakers, '') AS speakers, coalesce(n, 0) > 1 AS is_overlap FROM seg LEFT JOIN listed ON seg.call_id = listed.call_id AND seg.pos = listed.pos""")
def speakers_in_range(spark, sf_dir):
    segments, turns = _parts(spark, sf_dir)
    return I.speakers_in_range(segments, turns).select("call_id", "pos", F.array_join("speakers", ",").alias("speakers"), "is_overlap")


@query("midpoint_speaker", f"""WITH {EVENTS}, hit AS (SELECT s.call_id, s.pos, t.speaker FROM seg s JOIN turn t ON s.call_id = t.call_id AND (s.s0 + s.s1) / 2 BETWEEN t.s0 AND t.s1
QUALIFY row_number() OVER (PARTITION BY s.call_id, s.pos ORDER BY t.pos) = 1) SELECT seg.call_id, seg.pos, hit.speaker FROM seg LEFT JOIN hit ON seg.call_id = hit.call_id AND seg.pos = hit.pos""")
def midpoint_speaker(spark, sf_dir):
    segments, turns = _parts(spark, sf_dir)
    return I.midpoint_speaker(segments, turns).select("call_id", "pos", "speaker")


@query("overlap_stats", f"""WITH {EVENTS}, m AS (SELECT call_id, s0 AS t, 1 AS d FROM ev UNION ALL SELECT call_id, s1, -1 FROM ev), g AS (SELECT call_id, t, sum(d) AS d FROM m GROUP BY 1, 2),
x AS (SELECT call_id, sum(d) OVER w AS depth, lead(t) OVER w - t AS span FROM g WINDOW w AS (PARTITION BY call_id ORDER BY t)), o AS (SELECT call_id, sum(span) AS v FROM x WHERE depth >= 2 GROUP BY 1),
a AS (SELECT call_id, sum(s1 - s0) AS speech, max(s1) - min(s0) AS extent FROM ev GROUP BY 1)
SELECT a.call_id, round(coalesce(v, 0), 2) AS overlap, round(speech, 2) AS speech, round(extent, 2) AS extent, CASE WHEN extent > 0 THEN round(100 * coalesce(v, 0) / extent, 1) ELSE 0.0 END AS overlap_pct FROM a LEFT JOIN o ON a.call_id = o.call_id""")
def overlap_stats(spark, sf_dir):
    found = I.overlap_stats(intervals(spark, sf_dir))
    return found.select("call_id", *[F.round(c, 2).alias(c) for c in ("overlap", "speech", "extent")], "overlap_pct")


@query("vad_summary", f"""WITH {EVENTS}, a AS (SELECT call_id, max(s1) - min(s0) AS total FROM ev GROUP BY 1), b AS (SELECT call_id, sum(s1 - s0) AS v FROM seg GROUP BY 1)
SELECT a.call_id, round(coalesce(v, 0), 2) AS speech_seconds, round(total, 2) AS duration_seconds, CASE WHEN total > 0 THEN round(100 * coalesce(v, 0) / total, 1) ELSE 0.0 END AS speech_pct FROM a LEFT JOIN b ON a.call_id = b.call_id""")
def vad_summary(spark, sf_dir):
    every = intervals(spark, sf_dir)
    totals = every.groupBy("call_id").agg((F.max("end") - F.min("start")).alias("duration_seconds"))
    found = I.vad_summary(every.filter("speaker = 'view'"), totals)
    return found.select("call_id", F.round("speech_seconds", 2).alias("speech_seconds"), F.round("duration_seconds", 2).alias("duration_seconds"), "speech_pct")


@query("calendar_match", f"""WITH {EVENTS}, c AS (SELECT pos AS call_id, s0, s1 FROM ev WHERE speaker = 'purchase'), e AS (SELECT pos AS event_id, s0, s1 FROM ev WHERE speaker = 'signup')
SELECT c.call_id, e.event_id, round(least(c.s1, e.s1) - greatest(c.s0, e.s0), 4) AS seconds FROM c JOIN e ON e.s0 < c.s1 + 1800 AND e.s1 > c.s0 - 1800 WHERE least(c.s1, e.s1) - greatest(c.s0, e.s0) >= 60
QUALIFY row_number() OVER (PARTITION BY c.call_id ORDER BY least(c.s1, e.s1) - greatest(c.s0, e.s0) DESC, e.event_id) = 1""")
def calendar_match(spark, sf_dir):
    every = intervals(spark, sf_dir)
    calls = every.filter("speaker = 'purchase'").select(F.col("pos").alias("call_id"), "start", "end")
    events = every.filter("speaker = 'signup'").select(F.col("pos").alias("event_id"), "pos", "start", "end")
    return I.calendar_match(calls, events).withColumn("seconds", F.round("seconds", 4))


@query("attendee_candidates", """WITH named AS (SELECT DISTINCT c_nationkey AS k, lower(c_name) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P')
SELECT * FROM (SELECT c_nationkey AS call_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_name AS name, CAST(0.5 AS DOUBLE) AS score FROM customer) x
WHERE NOT EXISTS (SELECT 1 FROM named WHERE k = x.call_id AND n = lower(x.name))""")
def attendee_candidates(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    people = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda s: F.struct(s["c_name"].alias("name")))
    matched = customers.groupBy(F.col("c_nationkey").alias("call_id")).agg(people.alias("attendees"))
    named = customers.join(orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("call_id"), F.upper("c_name").alias("name"))
    return I.attendee_candidates(matched, named)


@query("candidate_fanout", "SELECT r_regionkey AS call_id, s_name AS local_label, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT s_name, n_regionkey AS rk FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON rk = r_regionkey")
def candidate_fanout(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    speakers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("call_id"), F.col("s_name").alias("local_label"))
    return I.candidate_fanout(speakers, nation.select(F.col("n_regionkey").alias("call_id"), F.col("n_name").alias("name")))


@query("pause_splits", f"""WITH {EVENTS}, g AS (SELECT call_id, pos, s0, lag(s1) OVER (PARTITION BY call_id ORDER BY s0) AS b FROM ev)
SELECT call_id, pos, floor((s0 + b) / 2 * 1000) / 1000 AS split FROM g WHERE s0 - b >= 3600""")
def pause_splits(spark, sf_dir):
    ordered = intervals(spark, sf_dir).withColumnRenamed("pos", "event_id").withColumn("pos", F.col("start"))
    found = S.pause_splits(ordered, 3600.0)
    keys = ordered.select("call_id", "pos", "event_id")
    return found.join(keys, ["call_id", "pos"]).select("call_id", F.col("event_id").alias("pos"), (F.floor(F.col("split") * 1000) / 1000).alias("split"))


@query("fixed_splits", f"""WITH {EVENTS}, e AS (SELECT call_id, min(s0) AS a, arg_max(s1, pos) AS b, arg_min(s0, pos) AS a0 FROM ev GROUP BY 1)
SELECT call_id, floor((a0 + i * 86400) * 1000) / 1000 AS split FROM (SELECT call_id, a0, b, unnest(range(1, CAST(ceil((b - a0) / 86400) AS BIGINT))) AS i FROM e WHERE ceil((b - a0) / 86400) > 1)""")
def fixed_splits(spark, sf_dir):
    return S.fixed_splits(intervals(spark, sf_dir), 86400.0).withColumn("split", (F.floor(F.col("split") * 1000) / 1000))


def _chunk_sql(target: float, splits: str) -> str:
    """Chunks of timed chats, turn by turn."""
    return f"""WITH RECURSIVE {CHATS}, l AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY pos) AS i, pos, length(coalesce(text, '')) AS n, coalesce(s0, 0) AS a, coalesce(s1, 0) AS e FROM ch),
g AS (SELECT call_id, sum(n) AS total, arg_min(a, i) AS a0, arg_max(e, i) AS e1 FROM l GROUP BY 1), lg AS (SELECT *, lag(e) OVER (PARTITION BY call_id ORDER BY i) AS b FROM l),
pause AS (SELECT call_id, list((a + b) / 2) AS sp FROM lg WHERE a - b >= 3 GROUP BY 1),
t AS (SELECT g.call_id, e1 - a0 >= {1.5 * target} OR total >= 1000 AS long, {splits} AS sp FROM g LEFT JOIN pause ON g.call_id = pause.call_id),
f AS (SELECT l.call_id, i, pos, n, CAST(0 AS INTEGER) AS chunk, n AS chars, a AS opened, long, sp FROM l JOIN t ON l.call_id = t.call_id WHERE i = 1
UNION ALL SELECT call_id, i, pos, n, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN n ELSE chars + n END, CASE WHEN cut THEN a ELSE opened END, long, sp
FROM (SELECT l.*, f.chunk, f.chars, f.opened, f.long, f.sp, f.long AND (f.chars + l.n > 1000 OR (l.e - f.opened >= {target} AND len(list_filter(f.sp, lambda x: x > f.opened AND x <= l.a)) > 0)) AS cut FROM f JOIN l ON l.call_id = f.call_id AND l.i = f.i + 1))
SELECT call_id, chunk AS chunk_id, CAST(min(pos) AS BIGINT) AS first_pos, CAST(sum(n) AS BIGINT) AS char_count, count(*) AS segments FROM f GROUP BY 1, 2"""


def _chunked(spark, sf_dir, **limits):
    found = S.chunks(timed_chats(spark, sf_dir), max_chars=1000, **limits)
    return found.select("call_id", "chunk_id", F.col("first_pos").cast("bigint").alias("first_pos"), "char_count", "segments")


@query("chunk_transcript", _chunk_sql(60.0, "coalesce(sp, [])"))
def chunk_transcript(spark, sf_dir):
    """Cut by characters, and by time at the pauses between turns."""
    return _chunked(spark, sf_dir, target_minutes=1.0)


@query("chunk_fixed", _chunk_sql(75.0, "list_transform(range(1, 1 + CAST(ceil(greatest(e1 - a0, 0) / 75) AS BIGINT)), lambda k: a0 + 75 * k)"))
def chunk_fixed(spark, sf_dir):
    """Calls without any pause long enough: by time at multiples of the target."""
    return _chunked(spark, sf_dir, target_minutes=1.25, min_pause=1e9)


@query("rate_schedule", """WITH RECURSIVE r AS (SELECT event_type, event_id, (epoch_us(ts) - 1700000000000000) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
g(event_type, event_id, i, t, granted) AS (SELECT event_type, event_id, i, t, t FROM r WHERE i < 40 UNION ALL SELECT r.event_type, r.event_id, r.i, r.t, greatest(r.t, g.granted + 54000.1) FROM g JOIN r ON r.event_type = g.event_type AND r.i = g.i + 40)
SELECT event_type, event_id, round(granted, 6) AS granted, round(granted - t, 6) AS wait FROM g""")
def rate_schedule(spark, sf_dir):
    """Events as requests by type, 40 in 15 hours."""
    asked = intervals(spark, sf_dir).select(F.col("speaker").alias("event_type"), F.col("pos").alias("event_id"), F.col("start").alias("t"))
    found = S.rate_schedule(asked, "event_type", "t", "event_id", window=54000.0, block=86400.0)
    return found.select("event_type", "event_id", F.round("granted", 6).alias("granted"), F.round("wait", 6).alias("wait"))


@query("turn_sections", f"""WITH {EVENTS}, g AS (SELECT *, lag(speaker) OVER (PARTITION BY call_id ORDER BY s0) AS b FROM ev)
SELECT call_id, pos, speaker, CAST(sum(CASE WHEN b IS NULL OR b <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY s0) AS BIGINT) AS section FROM g""")
def turn_sections(spark, sf_dir):
    ordered = intervals(spark, sf_dir).withColumnRenamed("pos", "event_id").withColumn("pos", F.col("start"))
    return S.turn_sections(ordered).select("call_id", F.col("event_id").alias("pos"), "speaker", "section")


@query("compact", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 50")
def compact(spark, sf_dir):
    return S.latest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", 50).select("user_id", "event_id")


@query("usage_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def usage_rate(spark, sf_dir):
    log = intervals(spark, sf_dir).select(F.col("pos").alias("event_id"), F.col("call_id").alias("user_id"), F.round(F.col("start") * 1e6).cast("bigint").alias("micros"))
    return S.usage_rate(log, "user_id", 600_000_000, "micros").select("event_id", "in_window")


@query("speaker_colours", "SELECT s_nationkey AS call_id, s_name AS speaker, CAST((dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1) % 10 AS INTEGER) AS colour FROM supplier")
def speaker_colours(spark, sf_dir):
    return S.speaker_ranks(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("call_id"), F.col("s_name").alias("speaker")))


@query("session_pauses", f"""WITH {EVENTS}, g AS (SELECT *, s0 - lag(s1) OVER (PARTITION BY call_id ORDER BY s0) >= 3600 AS cut FROM ev), s AS (SELECT call_id, s0, s1, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY s0) AS session FROM g)
SELECT call_id, CAST(session AS BIGINT) AS session, count(*) AS segments, floor(min(s0) * 1000) / 1000 AS "start" FROM s GROUP BY 1, 2""")
def session_pauses(spark, sf_dir):
    found = S.pause_sessions(intervals(spark, sf_dir), 3600.0)
    return found.groupBy("call_id", "session").agg(F.count("*").alias("segments"), (F.floor(F.min("start") * 1000) / 1000).alias("start"))


@query("timestamps", f"""WITH {EVENTS}, x AS (SELECT pos, CAST(floor(s1 - s0) AS BIGINT) AS s FROM ev)
SELECT pos AS event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, printf('%02d:%02d', s // 60, s % 60) AS minutes,
CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS human,
CASE WHEN s < 1024 THEN printf('%d B', s) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS size FROM x""")
def timestamps(spark, sf_dir):
    s = F.floor(F.col("end") - F.col("start")).cast("bigint")
    rows = intervals(spark, sf_dir).select(F.col("pos").alias("event_id"), s.alias("s"))
    x = F.col("s")
    return rows.select("event_id", clock(x).alias("clock"), minutes_clock(x).alias("minutes"), human_duration(x).alias("human"), human_size(x).alias("size"))


@query("talk_ratio", f"""WITH {CHATS}, p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS l FROM ch),
a AS (SELECT call_id, speaker, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS BIGINT) AS words, sum(len(l)) AS n, sum(len(list_filter(l, lambda x: suffix(x, '?')))) AS q, sum(s1 - s0) AS seconds,
sum(len(regexp_extract_all(lower(coalesce(text, '')), '\\b(we|our|us)\\b'))) AS we, sum(len(regexp_extract_all(lower(coalesce(text, '')), '\\b(i|my|me)\\b'))) AS i FROM p GROUP BY 1, 2)
SELECT call_id, speaker, words, round(CASE WHEN sum(words) OVER w > 0 THEN words / sum(words) OVER w ELSE 0 END, 6) AS talk_ratio, round(CASE WHEN seconds > 0 THEN 60 * words / seconds ELSE 0 END, 6) AS words_per_minute,
round(CASE WHEN n > 0 THEN q / n ELSE 0 END, 6) AS question_ratio, round(CASE WHEN i > 0 THEN we / i END, 6) AS we_ratio FROM a WINDOW w AS (PARTITION BY call_id)""")
def talk_ratio(spark, sf_dir):
    return M.talk_ratios(timed_chats(spark, sf_dir))


@query("longest_monologue", f"""WITH {EVENTS}, g AS (SELECT *, lag(speaker) OVER (PARTITION BY call_id ORDER BY pos) AS b FROM ev), r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY pos) AS run FROM g),
x AS (SELECT call_id, run, min(speaker) AS speaker, max(s1) - min(s0) AS seconds FROM r GROUP BY 1, 2) SELECT call_id, speaker, round(seconds, 4) AS seconds FROM x QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seconds DESC, speaker DESC) = 1""")
def longest_monologue(spark, sf_dir):
    return M.longest_monologue(intervals(spark, sf_dir)).withColumn("seconds", F.round("seconds", 4))


@query("dynamics", f"""WITH {EVENTS}, g AS (SELECT *, lag(speaker) OVER w AS sp, lag(s1) OVER w AS e, max(s1) OVER (PARTITION BY call_id ORDER BY s0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev WINDOW w AS (PARTITION BY call_id ORDER BY s0)),
x AS (SELECT call_id, count(*) FILTER (sp <> speaker) AS switches, count(*) FILTER (sp <> speaker AND s0 < e) AS interruptions, avg(s0 - e) FILTER (sp <> speaker AND s0 >= e) AS latency, max(s1) - min(s0) AS extent, coalesce(sum(greatest(0.0::DOUBLE, s0 - m)), 0) AS silence FROM g GROUP BY 1)
SELECT call_id, switches, interruptions, round(latency, 6) AS latency, round(switches / (extent / 60), 6) AS switches_per_minute, round(100.0::DOUBLE * silence / extent, 6) AS silence_pct FROM x""")
def dynamics(spark, sf_dir):
    return M.dynamics(intervals(spark, sf_dir))


@query("participation_gini", f"""WITH {CHATS}, a AS (SELECT call_id, speaker, sum(len(regexp_extract_all(text, '\\S+'))) AS x FROM ch GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY x, speaker) AS r FROM a)
SELECT call_id, count(*) AS speakers, round(CASE WHEN sum(x) > 0 THEN 2.0 * sum(r * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini FROM r GROUP BY 1""")
def participation_gini(spark, sf_dir):
    from palaver.operators.reports import speaker_stats

    return M.participation_gini(speaker_stats(timed_chats(spark, sf_dir)))


@query("meeting_class")
def meeting_class(spark, sf_dir):
    """Keyword classes of conversations; rows only, as the rules have many patterns."""
    return M.classify_meetings(timed_chats(spark, sf_dir))


@query("topic_segments", f"""WITH {EVENTS}, g AS (SELECT *, coalesce(s0 - lag(s1) OVER w > 5 AND lag(speaker) OVER w <> speaker, false) AS cut FROM ev WINDOW w AS (PARTITION BY call_id ORDER BY pos))
SELECT call_id, pos, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY pos) AS BIGINT) AS topic_no FROM g""")
def topic_segments(spark, sf_dir):
    return M.topic_segments(intervals(spark, sf_dir)).select("call_id", "pos", "topic_no")


#: Every third turn is heard as someone else, labels of users with an even id are two of the others, and all turns are half a second late.
_HEARD = "CASE WHEN pos % 3 = 0 THEN 'other' WHEN call_id % 2 = 0 AND speaker IN ('view', 'click') THEN 'both' ELSE reverse(speaker) END"
_DER = f"""WITH RECURSIVE {EVENTS}, tn AS (SELECT call_id, 'r' AS side, speaker, s0 AS a, s1 AS b FROM ev UNION ALL SELECT call_id, 'h', {_HEARD}, s0 + 0.5, s1 + 0.5 FROM ev),
o AS (SELECT *, max(b) OVER (PARTITION BY call_id, side, speaker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tn WHERE b > a),
k AS (SELECT *, sum(CASE WHEN m >= a THEN 0 ELSE 1 END) OVER (PARTITION BY call_id, side, speaker ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o),
isl AS (SELECT call_id, side, speaker, min(a) AS a, max(b) AS b FROM k GROUP BY call_id, side, speaker, g),
bd AS (SELECT DISTINCT call_id, unnest([a, b]) AS t FROM tn WHERE side = 'r' AND b > a),
mk AS (SELECT DISTINCT call_id, unnest([a, b]) AS t FROM isl UNION SELECT call_id, unnest([t - 0.25, t + 0.25]) FROM bd),
sp AS (SELECT call_id, t AS x, lead(t) OVER (PARTITION BY call_id ORDER BY t) AS y FROM mk),
sc AS (SELECT call_id, x, y FROM sp WHERE y > x AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.call_id = sp.call_id AND bd.t - 0.25 <= sp.x AND bd.t + 0.25 >= sp.y)),
act AS (SELECT sc.call_id, x, y, side, speaker FROM sc JOIN isl ON isl.call_id = sc.call_id AND isl.a <= sc.x AND isl.b >= sc.y),
n AS (SELECT call_id, y - x AS s, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM act GROUP BY call_id, x, y),
tot AS (SELECT call_id, sum(s * r) AS total, sum(s * greatest(r - h, 0)) AS missed, sum(s * greatest(h - r, 0)) AS alarm, sum(s * least(r, h)) AS b FROM n GROUP BY 1),
mx AS (SELECT p.call_id, p.speaker AS h, q.speaker AS r, sum(p.y - p.x) AS s FROM act p JOIN act q ON p.call_id = q.call_id AND p.x = q.x AND p.side = 'h' AND q.side = 'r' GROUP BY 1, 2, 3),
hl AS (SELECT call_id, h, row_number() OVER (PARTITION BY call_id ORDER BY h) AS i FROM (SELECT DISTINCT call_id, h FROM mx)),
pk(call_id, i, used, gain) AS (SELECT DISTINCT call_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS DOUBLE) FROM mx
UNION ALL SELECT pk.call_id, hl.i, CASE WHEN c.r IS NULL THEN used ELSE list_append(used, c.r) END, gain + coalesce(c.s, 0) FROM pk JOIN hl ON hl.call_id = pk.call_id AND hl.i = pk.i + 1
JOIN (SELECT call_id, h, r, s FROM mx UNION ALL SELECT call_id, h, NULL, NULL FROM hl) c ON c.call_id = hl.call_id AND c.h = hl.h AND (c.r IS NULL OR NOT list_contains(used, c.r))),
bs AS (SELECT call_id, max(gain) AS g FROM pk GROUP BY 1), al AS (SELECT DISTINCT call_id FROM ev)
SELECT al.call_id, round(coalesce(missed, 0), 6) AS missed, round(coalesce(alarm, 0), 6) AS false_alarm, round(greatest(coalesce(b, 0) - coalesce(g, 0), 0), 6) AS confusion, round(coalesce(total, 0), 6) AS total,
round(CASE WHEN total > 0 THEN (missed + alarm + greatest(b - coalesce(g, 0), 0)) / total ELSE 0 END, 6) AS der FROM al LEFT JOIN tot ON tot.call_id = al.call_id LEFT JOIN bs ON bs.call_id = al.call_id"""


@query("diarization_error", _DER)
def diarization_error(spark, sf_dir):
    turns = intervals(spark, sf_dir)
    found = M.diarization_error(turns, turns.withColumns({"speaker": F.expr(_HEARD), "start": F.col("start") + 0.5, "end": F.col("end") + 0.5}), width=86400.0)
    return found.select("call_id", *[F.round(c, 6).alias(c) for c in ("missed", "false_alarm", "confusion", "total", "der")])


ACTIONS = ["I will call. We decided to wait! ok", "An action item for you? Nothing here.", "let's go with blue", "Todo: paint. We need to talk. Agreed.", "Action: Noor calls. Bob will send it by Friday. He will see.", "Resolution: go. That was approved! It will be by then."]


@query("rule_actions", f"""WITH c AS (SELECT conv_id AS call_id, turn AS pos, text || '. ' || ['{"', '".join(a.replace("'", "''") for a in ACTIONS)}'][CAST(turn % 6 + 1 AS INTEGER)] AS text FROM conversations WHERE text IS NOT NULL), s AS (SELECT call_id, pos, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS text FROM c),
k AS (SELECT call_id, pos, CASE WHEN regexp_matches(lower(text), '\\b(we decided|decision|agreed|approved|let''s go with|we are going with)\\b') OR regexp_matches(lower(text), '\\bresolution:') THEN 'decision'
WHEN regexp_matches(lower(text), '\\b(action item|todo|to do|i will|i''ll|we will|we''ll|need to|follow up)\\b') OR regexp_matches(lower(text), '\\baction:')
OR regexp_matches(lower(text), '\\b[\\w.''-]+ will\\b.*\\bby (the )?(monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|tonight|tomorrow|next week|next month|end of day|eod|end of week|[0-9])') THEN 'action' END AS kind, text FROM s)
SELECT call_id, pos, kind, text FROM k WHERE kind IS NOT NULL""")
def rule_actions(spark, sf_dir):
    """Turns with a sentence of the kinds added, as the prose itself has none."""
    more = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("pos") % 6 + 1).cast("int"))
    return M.rule_actions(timed_chats(spark, sf_dir).filter("text IS NOT NULL").withColumn("text", F.concat("text", F.lit(". "), more)))


@query("consecutive_dedup", """WITH """ + LINES + """,
t AS (SELECT call_id, pos, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM lines), g AS (SELECT call_id, pos, t, lag(t) OVER (PARTITION BY call_id ORDER BY pos) AS b FROM t WHERE t <> '') SELECT call_id, pos FROM g WHERE b IS NULL OR b <> t""")
def consecutive_dedup(spark, sf_dir):
    return S.consecutive_dedup(lines(spark, sf_dir)).select("call_id", "pos")
