"""Readers, writers, hooks and streams on files."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palaver import hooks, schemas
from palaver.sources import readers, writers
from palaver.streaming import sync
from tests.test_operators import CALLS, SPEAKERS, TURN, resolved


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_schemas_parse(spark):
    for ddl in schemas.TABLES.values():
        assert len(spark.createDataFrame([], ddl).columns) > 4


def test_scan_files(spark, tmp_path):
    for name, size in (("a.MP3", 10), ("sub/b.wav", 20), ("c.txt", 9), ("skip/d.wav", 9), ("e_draft.wav", 5)):
        put(tmp_path, name, "x" * size)
    got = readers.scan_files(spark, str(tmp_path), ignore=("skip/*", "*_draft.*"), min_size=6)
    assert sorted((r["name"], r["size"]) for r in got.collect()) == [("a.MP3", 10), ("b.wav", 20)]
    assert "content" not in got.columns
    assert readers.scan_files(spark, str(tmp_path), recursive=False).count() == 2


def test_transcripts(spark, tmp_path):
    put(tmp_path, "call1.json", json.dumps({"text": "Hi all", "segments": [{"id": 0, "start": 0.0, "end": 1.0, "text": "Hi", "speaker": "S0"}, {"text": "all", "speaker": ["S0", "S1"]}], "metadata": {"file": {"modified": "2026-03-25T13:00:00Z"}}, "extra": 1}))
    put(tmp_path, "bad.json", "{nope")
    put(tmp_path, "manifest.json", "{}")
    put(tmp_path, "call1.embeddings.json", "{}")
    calls = readers.read_transcripts(spark, str(tmp_path))
    assert [r.call_id for r in calls.collect()] == ["call1"]
    got = readers.transcript_segments(calls).orderBy("pos").collect()
    assert [(r.pos, r.speaker, r.speakers, r.is_overlap) for r in got] == [(0, "S0", ["S0"], False), (1, "S0", ["S0", "S1"], True)]
    assert str(calls.select(readers.transcript_time(calls).alias("t")).first().t) == "2026-03-25 13:00:00"


def test_usage_manifest_identities(spark, tmp_path):
    log = put(tmp_path, "usage.jsonl", '{"timestamp": 1.5, "model": "m", "input_tokens": 3}\nnot json\n\n{"model": "n"}\n')
    assert sorted(r.model for r in readers.read_usage(spark, log).collect()) == ["m", "n"]
    m = put(tmp_path, "m.json", json.dumps({"version": "1.1", "files": {"h1": {"status": "completed", "tier": "draft"}}}))
    assert [(r.hash, r.status) for r in readers.read_manifest(spark, m).collect()] == [("h1", "completed")]
    assert readers.read_manifest(spark, put(tmp_path, "broken.json", "{oops")).count() == 0
    old = put(tmp_path, "v1.json", json.dumps({"speakers": {"Quinn": {"embedding": [1.0], "num_samples": 5}, "Noor": {"embedding": [0.5], "num_samples": 3}}}))
    people, occurrences, evidence = readers.read_identities(spark, old, "now")
    assert sorted((r.canonical_name, r.status, r.sample_count) for r in people.collect()) == [("Noor", "confirmed", 3), ("Quinn", "confirmed", 5)]
    new = put(tmp_path, "v2.json", json.dumps({"version": "2.0", "identities": {"spk_1": {"status": "unknown"}}, "occurrences": [{"call_id": "c"}], "evidence": [{"type": "t", "details": {"a": "b"}}]}))
    people, occurrences, evidence = readers.read_identities(spark, new)
    assert (people.first().speaker_cluster_id, occurrences.count(), evidence.first().details) == ("spk_1", 1, {"a": "b"})


def test_rttm_and_calendar(spark, tmp_path):
    path = put(tmp_path, "a.rttm", "SPEAKER k7 1 1.250 2.000 <NA> <NA> L1 <NA> <NA>\nLEXEME k7 1 0 1 a b c d\nSPEAKER short\nSPEAKER other 1 1.0 1.0 <NA> <NA> S1 <NA> <NA>\n")
    assert [tuple(r) for r in readers.read_rttm(spark, path, "k7").collect()] == [("k7", 1.25, 3.25, "L1")]
    turns = spark.createDataFrame([("c", 0, 0.0, 1.5, "A"), ("c", 1, 2.0, 3.0, "B"), ("d", 0, 1.0, 2.0, "A")], TURN)
    writers.write_rttm(turns, f"{tmp_path}/out")
    back = readers.read_rttm(spark, f"{tmp_path}/out/*")
    assert sorted(tuple(r) for r in back.collect()) == [("c", 0.0, 1.5, "A"), ("c", 2.0, 3.0, "B"), ("d", 1.0, 2.0, "A")]
    event = {"id": "e", "subject": "Standup", "start": {"dateTime": "2026-03-25T14:00:00.0000000"}, "end": {"dateTime": "2026-03-25T14:30:00Z"}, "attendees": [{"emailAddress": {"name": "Dana Lee", "address": "d@x"}, "type": "required"}]}
    for name, body in (("l.json", [event]), ("v.json", {"value": [event]})):
        r = readers.read_calendar(spark, put(tmp_path, f"cal/{name}", json.dumps(body))).first()
        assert (r.event_id, r.end - r.start, r.attendees[0].name) == ("e", 1800.0, "Dana Lee")


def test_tags_and_paths(spark):
    tags = F.create_map(F.lit("Sub Title"), F.lit(" Song "), F.lit("junk"), F.lit("x"), F.lit("artist"), F.lit(""))
    assert spark.range(1).select(readers.normalised_tags(tags).alias("t")).first().t == {"sub_title": "Song", "junk": "x"}
    assert [r.path for r in readers.paths_table(spark, [" a.wav \n", "", "b.wav"]).collect()] == ["a.wav", "b.wav"]


def test_writers(spark, tmp_path):
    row = spark.createDataFrame([("h", "pending", 1.0)], "hash string, status string, last_updated double")
    writers.upsert_manifest(row, f"{tmp_path}/m")
    writers.upsert_manifest(row.withColumns({"status": F.lit("completed"), "last_updated": F.lit(2.0)}), f"{tmp_path}/m")
    assert [r.status for r in writers.read_table(spark, f"{tmp_path}/m").collect()] == ["completed"]
    speakers = spark.createDataFrame([("c", "S0", [0.1, 0.2, 0.3])], "call_id string, local_label string, embedding array<double>")
    writers.write_embeddings(speakers, f"{tmp_path}/e")
    assert json.loads(spark.read.text(f"{tmp_path}/e").first().value)["S0"]["dimension"] == 3
    assert json.loads(writers.envelope(row, "status").first().value) == {"ok": True, "command": "status", "data": {"hash": "h", "status": "pending", "last_updated": 1.0}, "meta": {"version": "1.0", "elapsed_seconds": 0.0}}
    documents = spark.createDataFrame([("c", "text"), ("d", "more")], "call_id string, document string")
    writers.export_once(documents.limit(1), f"{tmp_path}/s", f"{tmp_path}/o")
    writers.export_once(documents, f"{tmp_path}/s", f"{tmp_path}/o")
    assert spark.read.json(f"{tmp_path}/o").count() == 2
    writers.append_usage(row, f"{tmp_path}/u")
    writers.write_json(row, f"{tmp_path}/j")
    writers.write_documents(documents, f"{tmp_path}/docs")
    assert spark.read.text(f"{tmp_path}/docs").count() == 2


def test_hooks(spark):
    def factory():
        return lambda rows: pd.DataFrame({"call_id": rows["call_id"], "language": "en", "probability": [1.0 / len(x) for x in rows["text"]]})

    hooks.register("toy", factory, hooks.LANGUAGE)
    rows = spark.createDataFrame([("a", "xx"), ("b", "")], "call_id string, text string").coalesce(1)
    assert hooks.run(rows.limit(1), "toy").first().probability == 0.5
    assert {r.error_type for r in hooks.run(rows, "toy", errors=True).collect()} == {"ZeroDivisionError"}
    with pytest.raises(KeyError):
        hooks.run(rows, "none")
    assert "toy" in hooks.backends()


def test_sync_of_files(spark, tmp_path):
    put(tmp_path, "in/a.wav", "one")
    put(tmp_path, "in/copy.wav", "one")
    clock = iter(range(1, 100))

    def cycle(n):
        stream = sync.file_stream(spark, f"{tmp_path}/in", "*.wav")
        sync.watch(stream, lambda new: new.select("path", "hash"), f"{tmp_path}/out", f"{tmp_path}/m", f"{tmp_path}/check{n}", "draft", "1.0", lambda: float(next(clock))).awaitTermination()
        return sync.results(spark, f"{tmp_path}/out", f"{tmp_path}/m").count()

    assert [cycle(1), cycle(2)] == [1, 1]  # a lost checkpoint repeats nothing
    put(tmp_path, "in/b.wav", "two")
    assert cycle(2) == 2 and writers.read_table(spark, f"{tmp_path}/m").filter("status = 'completed'").count() == 2


def test_sync_survives_a_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    entries = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1")], "path string, hash string")
    process = lambda new: new.select("path", "hash")
    run = lambda rows, now: sync.run_once(rows, process, f"{tmp_path}/out", f"{tmp_path}/m", "draft", "1.0", now)
    with monkeypatch.context() as broken:
        broken.setattr(sync, "upsert_manifest", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            run(entries, 1.0)
    run(entries.unionByName(spark.createDataFrame([("d", "h3")], entries.schema)), 2.0)
    run(entries, 3.0)
    assert sorted(r.hash for r in sync.results(spark, f"{tmp_path}/out", f"{tmp_path}/m").collect()) == ["h1", "h2", "h3"]


def test_sync_records_errors_and_retries_transient_ones(spark, tmp_path):
    entries = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, hash string")
    seen = []

    def process(new):
        seen.append(sorted(r.hash for r in new.select("hash").collect()))
        kind = F.when(F.col("hash") == "h1", "ValueError").when((F.col("hash") == "h2") & F.lit(len(seen) == 1), "ConnectionResetError")
        return new.select("path", "hash", kind.alias("error_type"), F.when(kind.isNotNull(), "no luck").alias("error"))

    for now in (1.0, 2.0, 3.0):
        sync.run_once(entries, process, f"{tmp_path}/out", f"{tmp_path}/m", "draft", "1.0", now)
    assert seen == [["h1", "h2", "h3"], ["h2"]]
    assert {(r.hash, r.status, r.error_category) for r in writers.read_table(spark, f"{tmp_path}/m").collect()} == {("h1", "error", "permanent"), ("h2", "completed", None), ("h3", "completed", None)}
    assert sorted(r.hash for r in sync.results(spark, f"{tmp_path}/out", f"{tmp_path}/m").collect()) == ["h2", "h3"]


def test_progress_and_streamed_results(spark, tmp_path):
    spark.createDataFrame([("a", "completed"), ("b", "failed")], "file string, status string").write.json(f"{tmp_path}/in")
    events = []
    listener = writers.Progress(events.append)
    spark.streams.addListener(listener)
    writers.stream_results(spark.readStream.schema("file string, status string").json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    spark.streams.removeListener(listener)
    assert sorted(json.loads(r.value)["file"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["a", "b"]
    assert {e["event"] for e in events} >= {"started"}


def test_retries_wait_until_they_are_due(spark, tmp_path):
    """Three attempts of a transient error at 0, 1 and 3 seconds and never again, without the entries being listed again."""
    entries = spark.createDataFrame([("a", 7, "h1"), ("b", 8, "h2")], "path string, size int, hash string")
    seen = []

    def process(new):
        kind = F.when(F.col("hash") == "h1", "TimeoutError")
        seen.append((at, sorted(tuple(r) for r in new.select("path", "size", "hash", "attempts").collect())))
        return new.select("path", "hash", "attempts", kind.alias("error_type"), kind.alias("error"))

    for at in (0.0, 0.9, 1.0, 2.9, 3.0, 10.0, 99.0):
        sync.run_once(entries if at == 0 else entries.limit(0), process, f"{tmp_path}/out", f"{tmp_path}/m", "draft", "1.0", at)
    assert seen == [(0.0, [("a", 7, "h1", 0), ("b", 8, "h2", 0)]), (1.0, [("a", 7, "h1", 1)]), (3.0, [("a", 7, "h1", 2)])]
    assert {(r.hash, r.status, r.attempts, r.due) for r in writers.read_table(spark, f"{tmp_path}/m").collect()} == {("h1", "error", 3, None), ("h2", "completed", 1, None)}


def test_a_watch_retries_while_nothing_arrives(spark, tmp_path):
    import time

    spark.createDataFrame([("a", "h1")], "path string, hash string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, hash string").parquet(f"{tmp_path}/in")
    fails = F.when(F.col("attempts") < 1, "TimeoutError")
    query = sync.watch(stream, lambda new: new.select("path", "hash", fails.alias("error_type"), fails.alias("error")), f"{tmp_path}/out", f"{tmp_path}/m", f"{tmp_path}/check", "draft", "1.0", time.time, seconds=1)
    try:
        until = time.time() + 60
        done = lambda: [(r.status, r.attempts) for r in sync.manifest_of(spark, f"{tmp_path}/m").select("status", "attempts").collect()] if writers.exists(spark, f"{tmp_path}/m") else []
        while done() != [("completed", 2)] and time.time() < until and query.isActive:
            time.sleep(0.5)
        assert done() == [("completed", 2)]
    finally:
        query.stop()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_resolver_stream_equals_batch(spark, tmp_path, rocks):
    """Calls that come in parts, over micro-batches, each after a restart."""
    import time

    rows = spark.createDataFrame(CALLS, SPEAKERS).withColumn("tenant", F.lit("t")).withColumn("ended", F.lit(False))
    parts = rows.collect()
    first = sorted((r for r in parts if r.call_id == "c1"), key=lambda r: r.local_label)
    second = sorted((r for r in parts if r.call_id == "c2"), key=lambda r: r.local_label)
    end = spark.createDataFrame([second[0]], rows.schema).withColumns({"local_label": F.lit(None).cast("string"), "ended": F.lit(True)})
    batches = [spark.createDataFrame(x, rows.schema) for x in (first[:1], first[1:] + second[:1], second[1:])]
    batches = [b for b in batches if not b.isEmpty()]
    batches[-1] = batches[-1].unionByName(end)
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
        query = sync.resolve_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
        try:
            until = time.time() + 90
            while sum(p["numInputRows"] for p in query.recentProgress) < batch.count() and time.time() < until and query.isActive:
                time.sleep(0.5)
        finally:
            query.stop()
    resolved(spark.read.parquet(f"{tmp_path}/out").collect())


def test_an_idle_call_is_closed_by_its_timer(spark, tmp_path, rocks):
    import time

    rows = spark.createDataFrame(CALLS, SPEAKERS).withColumn("tenant", F.lit("t"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = sync.resolve_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), idle_seconds=1.0).writeStream.format("memory").queryName("idle").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while spark.table("idle").count() < len(CALLS) and time.time() < until and query.isActive:
            time.sleep(0.5)
        resolved(spark.table("idle").collect())
    finally:
        query.stop()


def test_live_sessions_split_at_the_exact_pause(spark):
    rows = spark.sql("SELECT 'c' call_id, timestamp_seconds(x) ts, timestamp_seconds(x + 1) e FROM VALUES (0), (3), (7) AS v(x)")
    assert sorted(r.segments for r in sync.live_sessions(rows, F.col("e"), 3.0).collect()) == [1, 2]


def test_probe_metadata(spark, tmp_path):
    put(tmp_path, "p.json", json.dumps({"format": {"filename": "a.m4a", "duration": "61.5", "bit_rate": "x", "tags": {"TITLE": "Standup"}}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "aac", "channels": 1, "sample_rate": "16000", "tags": {"TITLE": "other", "encoder": "e"}}]}))
    r = readers.read_metadata(spark, str(tmp_path)).first()
    assert (r.duration_seconds, r.bit_rate, r.codec, r.sample_rate, r.tags) == (61.5, None, "aac", 16000, {"title": "Standup", "encoder": "e"})
