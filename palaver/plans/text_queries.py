"""Queries of text operators: repetition, risk, name hints and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import hints as H
from palaver.operators import quality as Q
from palaver.operators import render as Rn
from palaver.operators import sequence as S
from palaver.operators import summary as Su
from palaver.plans.registry import CHATS, LINES, chats, intervals, lines, literal_rows, query, table, timed_chats
from palaver.sources.readers import parse_rttm

GRAMS = LINES + r""", w AS (SELECT call_id, pos, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM lines), g AS (SELECT call_id, pos, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM w WHERE len(t) >= 3),
k AS (SELECT call_id, pos, g, count(*) AS n FROM g GROUP BY 1, 2, 3), tot AS (SELECT call_id, pos, sum(n) AS n FROM k GROUP BY 1, 2), sh AS (SELECT a.call_id, a.pos, sum(least(a.n, b.n)) AS n FROM k a JOIN k b ON a.call_id = b.call_id AND b.pos = a.pos - 1 AND a.g = b.g GROUP BY 1, 2),
rep AS (SELECT lines.call_id, lines.pos, lines.text, coalesce(sh.n / tot.n >= 0.6, false) AS repeated FROM lines LEFT JOIN tot ON tot.call_id = lines.call_id AND tot.pos = lines.pos LEFT JOIN sh ON sh.call_id = lines.call_id AND sh.pos = lines.pos)"""


@query("repetition_flags", f"WITH {GRAMS} SELECT call_id, pos, repeated FROM rep")
def repetition_flags(spark, sf_dir):
    return S.repetition_flags(lines(spark, sf_dir)).select("call_id", "pos", "repeated")


def _proxy(segments):
    """Lines with a stand-in for model confidence and energy."""
    size = F.length("text")
    return segments.withColumn("confidence", F.when(size % 5 == 0, F.lit(0.1))).withColumn("avg_logprob", F.when(size % 5 == 1, -(size % 10).cast("double") / 5)).withColumn("low", size % 7 == 0)


RISK = GRAMS + """, c AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 0.1::DOUBLE WHEN length(text) % 5 = 1 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, exp(-(length(text) % 10)::DOUBLE / 5))) END AS confidence FROM rep),
f AS (SELECT *, CAST(coalesce(confidence < 0.4, false) AS INTEGER) + CAST(repeated AS INTEGER) + CAST(length(text) % 7 = 0 AS INTEGER) AS flags FROM c)"""


@query("hallucination_risk", f"WITH {RISK} SELECT call_id, pos, round(confidence, 6) AS confidence, ['none', 'low', 'medium', 'high'][flags + 1] AS risk FROM f WHERE flags < 3")
def hallucination_risk(spark, sf_dir):
    flagged = Q.apply_filter(Q.flag_segments(_proxy(lines(spark, sf_dir)), energy="low"), "auto")
    return flagged.select("call_id", "pos", F.round("confidence", 6).alias("confidence"), "risk")


@query("quality_summary", f"WITH {RISK} SELECT call_id, round(avg(confidence), 6) AS confidence, count(*) FILTER (flags >= 2) AS hallucination_flags FROM f GROUP BY 1")
def quality_summary(spark, sf_dir):
    return Q.quality_summary(Q.flag_segments(_proxy(lines(spark, sf_dir)), energy="low")).withColumn("confidence", F.round("confidence", 6))


SAID = [
    (-1, 0, "S0", 0.0, "Morning all, this is Quinn speaking. Thank you Noor, lovely slides."), (-1, 1, "S1", 1.0, "Hi Quinn, can you hear us? I am Noor from Basalt."), (-1, 2, "S1", 2.0, "Thanks Friday was fine. Okay Imre, over to you."), (-1, 3, "S0", 3.0, "my name is Quinn. Ilse here. I'm Otto."), (-2, 0, None, 0.0, "right Juno, hello Tove!"),
]
_SAID = ", ".join(f"({c}, {p}, {'NULL' if s is None else repr(s)}, {t}::DOUBLE, '{x.replace(chr(39), chr(39) * 2)}')" for c, p, s, t, x in SAID)
_UNION = " UNION ALL ".join(f"SELECT call_id, pos, speaker, ts, {i} AS o, '{n}' AS pattern, {s}::DOUBLE AS confidence, {str(own).lower()} AS own, regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}', 1) AS names FROM s" for i, (rx, n, s, own) in enumerate(H.PATTERNS))
_STOP = ", ".join(f"'{w}'" for w in H.NO_NAMES)


@query("name_hints", rf"""WITH s AS (SELECT * FROM (VALUES {_SAID}) v(call_id, pos, sp, ts, text) UNION ALL SELECT doc_id, 0, NULL, 0.0, text FROM documents WHERE text IS NOT NULL),
s2 AS (SELECT call_id, pos, coalesce(sp, '') AS speaker, ts, text FROM s), p AS ({_UNION.replace(' FROM s', ' FROM s2')}),
x AS (SELECT call_id, pos, speaker, ts, o, pattern, confidence, own, generate_subscripts(names, 1) AS k, unnest(names) AS name FROM p),
y AS (SELECT * FROM x WHERE length(name) BETWEEN 2 AND 15 AND regexp_matches(name, '^\p{{Lu}}\p{{L}}*$') AND name NOT IN ({_STOP}) QUALIFY row_number() OVER (PARTITION BY call_id, lower(name), speaker ORDER BY pos, o, k) = 1)
SELECT call_id, pos, name, speaker, ts AS "timestamp", pattern, confidence, row_number() OVER (PARTITION BY call_id ORDER BY confidence DESC, pos, pattern, name, speaker) AS rank, CASE WHEN own THEN speaker ELSE 'addressed_by_' || speaker END AS target FROM y""")
def name_hints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("speaker"), F.lit(0.0).alias("start"), "text")
    said = literal_rows(spark, SAID, "call_id bigint, pos int, speaker string, start double, text string")
    return H.ranked_hints(H.routed_hints(H.name_hints(said.unionByName(docs)))).withColumn("rank", F.col("rank").cast("bigint"))


BODY = r"""t AS (SELECT *, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM ch), k AS (SELECT *, last_value(nullif(speaker, '') IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, printf('%02d:%02d', CAST(s0 AS BIGINT) // 60, CAST(s0 AS BIGINT) % 60) AS tm FROM t WHERE t <> ''),
l AS (SELECT call_id, pos, CASE WHEN speaker <> '' AND speaker IS DISTINCT FROM b THEN '### ' || speaker || ' — ' || tm || chr(10) || chr(10) ELSE '' END || CASE WHEN coalesce(speaker, '') = '' THEN '**[' || tm || ']** ' ELSE '' END || CASE WHEN length(text) % 10 = 0 THEN '[?] ' ELSE '' END || t || chr(10) AS line FROM k),
body AS (SELECT c.call_id, '## Transcript' || chr(10) || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY pos), '') AS body FROM (SELECT DISTINCT call_id FROM ch) c LEFT JOIN l ON l.call_id = c.call_id GROUP BY 1)"""
#: Some turns lose their speaker or their words, so that every branch is met.
BODY_CHATS = CHATS.replace("role AS speaker, text,", "CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 7 = 6 THEN '' ELSE role END AS speaker, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text,")


def _body_chats(spark, sf_dir):
    turns, pos = timed_chats(spark, sf_dir), F.col("pos")
    turns = turns.withColumns({"speaker": F.when(pos % 4 == 3, None).when(pos % 7 == 6, "").otherwise(F.col("speaker")), "text": F.when(pos % 5 == 4, " ").otherwise(F.col("text"))})
    return turns.withColumn("confidence", F.when(F.length("text") % 10 == 0, 0.1).otherwise(0.9))


@query("transcript_body", f"WITH {BODY_CHATS}, {BODY} SELECT call_id, body FROM body")
def transcript_body(spark, sf_dir):
    return Rn.transcript_body(_body_chats(spark, sf_dir))


@query("markdown_doc", f"""WITH {BODY_CHATS}, {BODY} SELECT call_id, concat_ws(chr(10) || chr(10), concat_ws(chr(10), '---', 'title: "Transcript: call-' || call_id || '"', 'date: 2026-01-01', 'source: palaver', 'duration: 61.5', 'language: en', CASE WHEN call_id % 2 = 0 THEN 'speakers: [Ada (spk_1), spk_2]' || chr(10) || 'speaker_count: 2' ELSE 'speakers: [A, B]' END,
'classification: call', 'topics: [Two Words]', CASE WHEN call_id % 2 = 1 THEN 'action_items: 1' END, 'decisions: 1', 'tags: [transcript, palaver, call, two-words]', '---'), '# Transcript: call-' || call_id, '**Type:** call',
concat_ws(chr(10), '## Metadata', '', '| Property | Value |', '|----------|-------|', '| Duration | 1m 1s |', '| Language | en |', '| File Size | 2.0 KB |', '| Codec | opus |', '| Sample Rate | 16000 Hz |', '| Speakers | 2 |'), CASE WHEN call_id % 3 = 0 THEN '## Summary' || chr(10) || chr(10) || 'All said.' END,
CASE WHEN call_id % 2 = 1 THEN '## Action Items' || chr(10) || chr(10) || '- [ ] write — Ada (by Friday)' END, '## Key Decisions' || chr(10) || chr(10) || '- go', '**Topics:** Two Words', CASE WHEN call_id % 2 = 0 THEN '**Speakers:** [[Ada]], [[spk_2]]' END, body) AS document FROM body""")
def markdown_doc(spark, sf_dir):
    turns, even = _body_chats(spark, sf_dir), F.col("call_id") % 2 == 0
    text = F.lit(None).cast("string")
    resolved = F.array(F.struct(F.lit("Ada").alias("display_name"), F.lit("spk_1").alias("speaker_cluster_id")), F.struct(text.alias("display_name"), F.lit("spk_2").alias("speaker_cluster_id")))
    action = F.array(F.struct(F.lit("write").alias("text"), F.lit("Ada").alias("assignee"), F.lit("Friday").alias("deadline")))
    calls = turns.select("call_id").distinct().select(
        "call_id", F.concat(F.lit("call-"), F.col("call_id").cast("string")).alias("stem"), text.alias("day"), F.lit(61.5).alias("duration_seconds"), F.lit("en").alias("language"), text.alias("backend"), F.array(F.lit("A"), F.lit("B")).alias("speakers"),
        F.when(even, resolved).alias("speakers_resolved"), F.lit("").alias("title"), F.lit("call").alias("classification"), F.array(F.lit("Two Words")).alias("topics"), F.when(~even, action).alias("action_items"), F.array(F.lit("go")).alias("key_decisions"),
        F.when(F.col("call_id") % 3 == 0, "All said.").otherwise("").alias("summary"), F.lit(2048).alias("size"), F.lit("opus").alias("codec"), F.lit(16000).alias("sample_rate"), F.lit(2).alias("num_speakers"),
    )
    return Rn.markdown(calls, turns, today="2026-01-01")


@query("front_matter", """SELECT p_partkey AS call_id, concat_ws(chr(10), '---', 'title: "' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Transcript: f' || p_partkey END || '"', 'date: 2026-01-01', 'source: palaver', 'duration: 90.5', 'classification: ' || p_brand, 'topics: [' || p_type || ']',
'tags: [transcript, palaver, ' || p_brand || ', ' || replace(lower(p_type), ' ', '-') || ']', '---') AS front_matter FROM part""")
def front_matter(spark, sf_dir):
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    calls = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("call_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("stem"), F.lit("2026-01-01").alias("day"), F.lit(90.5).alias("duration_seconds"), none.alias("language"), none.alias("backend"), empty.alias("speakers"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("classification"), F.array("p_type").alias("topics"), empty.alias("action_items"), empty.alias("key_decisions"),
    )
    return Rn.front_matter(calls).select("call_id", "front_matter")


@query("rttm_roundtrip", "SELECT CAST(user_id AS VARCHAR) AS call_id, event_type AS speaker, count(*) AS turns FROM events GROUP BY 1, 2")
def rttm_roundtrip(spark, sf_dir):
    read = parse_rttm(Rn.rttm_lines(intervals(spark, sf_dir)).select(F.col("line").alias("value")))
    return read.groupBy("call_id", "speaker").agg(F.count("*").alias("turns"))


@query("subtitles", f"""WITH {CHATS} SELECT call_id, string_agg((pos + 1) || chr(10) || printf('%02d:%02d:%02d,000', CAST(s0 AS BIGINT) // 3600, CAST(s0 AS BIGINT) % 3600 // 60, CAST(s0 AS BIGINT) % 60) || ' --> ' || printf('%02d:%02d:%02d,%03d', m // 3600000, m % 3600000 // 60000, m % 60000 // 1000, m % 1000)
|| chr(10) || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || chr(10), chr(10) ORDER BY pos) AS document FROM (SELECT *, CAST(floor(s1 * 1000 + 0.5) AS BIGINT) AS m FROM ch) GROUP BY 1""")
def subtitles(spark, sf_dir):
    return Rn.subtitles(timed_chats(spark, sf_dir), "srt")


@query("audio_snr", """WITH s AS (SELECT vec_id, list_concat(embedding, embedding) AS e FROM embeddings), f AS (SELECT vec_id, k, sqrt(list_sum(list_transform(list_slice(e, k * 6 + 1, k * 6 + 16), lambda x: CAST(x AS DOUBLE) * x)) / 16) AS rms FROM s, (SELECT unnest(range(0, 1000)) AS k) WHERE k * 6 + 16 <= len(e)),
r AS (SELECT vec_id, rms, row_number() OVER (PARTITION BY vec_id ORDER BY rms) AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM f), q AS (SELECT vec_id, any_value(n) AS n, avg(rms) FILTER (i <= greatest(1, n // 10)) AS noise, avg(rms) FILTER (i > n - greatest(1, n // 10)) AS signal FROM r GROUP BY 1)
SELECT s.vec_id AS call_id, round(CASE WHEN coalesce(n, 0) >= 10 AND noise > 0 AND signal > 0 THEN 20 * log10(signal / noise) ELSE 0 END, 6) AS snr_db FROM s LEFT JOIN q ON s.vec_id = q.vec_id""")
def audio_snr(spark, sf_dir):
    """Signal-to-noise of vectors as short recordings at 640 samples a second, repeated once so that there are ten frames."""
    audio = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("call_id"), F.concat("embedding", "embedding").alias("samples"))
    return Q.compute_snr(audio, 640).withColumn("snr_db", F.round("snr_db", 6))


@query("segment_energy", "SELECT vec_id AS call_id, 0 AS pos, round(sqrt(sum(x * x) / count(*)), 9) < 0.125 AS low_energy FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) * (1 + vec_id % 3) AS x FROM embeddings) GROUP BY 1")
def segment_energy(spark, sf_dir):
    louder = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 3))
    audio = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("call_id"), F.lit(0).alias("pos"), F.lit(10.0).alias("duration_seconds"), louder.alias("samples"))
    return Q.segment_energy(audio, least=0.125)

@query("recording_energy", """WITH s AS (SELECT vec_id, pos, CAST(floor(a * 16) AS BIGINT) AS i, least(CAST(floor(b * 16) AS BIGINT), 64) AS j FROM embeddings, (VALUES (0, 0.0, 1.0), (1, 0.55, 3.3), (2, 3.0, 9.0), (3, 2.0, 2.0), (4, 5.0, 6.0)) v(pos, a, b)),
x AS (SELECT s.vec_id, pos, i, j, list_sum(list_transform(list_slice(embedding, i + 1, j), lambda x: CAST(x AS DOUBLE) * x)) AS e FROM s JOIN embeddings USING (vec_id))
SELECT vec_id AS call_id, pos, CASE WHEN vec_id % 10 <> 0 AND i < j THEN round(sqrt(e / (j - i)), 6) END AS rms, CASE WHEN vec_id % 10 = 0 THEN false WHEN i >= j THEN true ELSE round(sqrt(e / (j - i)), 9) < 0.125 END AS low_energy FROM x""")
def recording_energy(spark, sf_dir):
    """Vectors as recordings of 16 samples a second, cut into blocks of ten; every tenth has a file too large to judge."""
    audio = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("call_id"), F.col("embedding").alias("samples"))
    recordings = audio.select("call_id", F.lit(16).alias("rate"), F.size("samples").alias("samples"), F.when(F.col("call_id") % 10 == 0, F.lit(10**9)).alias("bytes"))
    spans = [(0, 0.0, 1.0), (1, 0.55, 3.3), (2, 3.0, 9.0), (3, 2.0, 2.0), (4, 5.0, 6.0)]
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(a).alias("start"), F.lit(b).alias("end")) for p, a, b in spans])).alias("p")
    segments = audio.select("call_id", parts).select("call_id", "p.*")
    return Q.recording_energy(recordings, Q.sample_blocks(audio, 10), segments, 10, least=0.125).withColumn("rms", F.round("rms", 6))


@query("extractive_summary", r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS l FROM documents),
s AS MATERIALIZED (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM p), w AS MATERIALIZED (SELECT doc_id, pos, sentence, list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')) AS w FROM s),
sim AS MATERIALIZED (SELECT a.doc_id, a.pos AS x, b.pos AS y, len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)) AS v FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.pos <> b.pos WHERE len(a.w) > 0 AND len(b.w) > 0),
step AS MATERIALIZED (SELECT doc_id, x, y, v / sum(v) OVER (PARTITION BY doc_id, x) AS v FROM sim WHERE v > 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
r(k, doc_id, pos, n, score) AS (SELECT 0, doc_id, pos, n, 1 / n FROM s JOIN n USING (doc_id)
UNION ALL SELECT k + 1, doc_id, pos, n, 0.15 / n + 0.85 * coalesce(got, 0) FROM (SELECT r.k, r.doc_id, r.pos, r.n, (SELECT sum(f.score * step.v) FROM r f JOIN step ON step.doc_id = f.doc_id AND step.x = f.pos WHERE step.doc_id = r.doc_id AND step.y = r.pos) AS got FROM r) WHERE k < 6),
t AS (SELECT doc_id, pos, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS i FROM r JOIN s USING (doc_id, pos) WHERE k = 6)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM t WHERE i <= 3 GROUP BY 1""".replace("\\\\", "\\"))
def extractive_summary(spark, sf_dir):
    """The three sentences of each document that rank highest after six rounds."""
    return Su.extractive_summary(table(spark, sf_dir, "documents"), "doc_id", rounds=6, tolerance=0.0).select("doc_id", "summary")
