"""Documents as text: front matter, metadata table, transcript body, subtitles and turn files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.scalars import clock, human_duration, human_size, padded, slug, strip
from palaver.operators.analysis import ordered

SOURCE = "palaver"


def _line(name: str, value: Column) -> Column:
    """``name: value``, or null without a value, which concat_ws leaves out."""
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{name}: "), value.cast("string")))


def _listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")))


def _count(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.size(values))


def _given(calls: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or null where the calls don't have it."""
    return F.col(name) if name in calls.columns else F.lit(None).cast(kind)


def front_matter(calls: DataFrame, out: str = "front_matter", today: str | None = None) -> DataFrame:
    """``calls`` with a YAML block.

    Columns: stem, day, duration_seconds, language, backend, speakers, title, classification, topics, action_items, key_decisions, and if there are any
    speakers_resolved (array of display_name, speaker_cluster_id), which come before speakers. ``today`` stands in for a missing day.
    """
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Transcript: "), F.col("stem")))
    tags = F.concat(
        F.array(F.lit("transcript"), F.lit(SOURCE)),
        F.array_compact(F.array(F.nullif(F.col("classification"), F.lit("")))),
        F.transform(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 5), slug),
    )
    resolved = _given(calls, "speakers_resolved", "array<struct<display_name:string,speaker_cluster_id:string>>")
    cluster = lambda s: F.coalesce(s["speaker_cluster_id"], F.lit(""))
    name = lambda s: F.coalesce(F.nullif(s["display_name"], F.lit("")), cluster(s))
    labels = F.transform(resolved, lambda s: F.when(name(s) != cluster(s), F.concat(name(s), F.lit(" ("), cluster(s), F.lit(")"))).otherwise(cluster(s)))
    return calls.withColumn(
        out,
        F.concat_ws(
            "\n", F.lit("---"), F.concat(F.lit('title: "'), title, F.lit('"')), _line("date", F.coalesce(F.col("day"), F.lit(today))), F.lit(f"source: {SOURCE}"), _line("duration", F.nullif(F.col("duration_seconds"), F.lit(0.0))), _line("language", F.col("language")),
            _line("backend", F.col("backend")), _line("speakers", F.coalesce(_listed(labels), _listed(F.col("speakers")))), _line("speaker_count", _count(resolved)), _line("classification", F.col("classification")), _line("topics", _listed(F.col("topics"))),
            _line("action_items", _count(F.col("action_items"))), _line("decisions", _count(F.col("key_decisions"))), _line("tags", _listed(tags)), F.lit("---"),
        ),
    )


def metadata_table(calls: DataFrame, out: str = "metadata_table") -> DataFrame:
    """``calls`` with a section of a two-column table: duration, language, backend, size, codec, sample_rate, num_speakers.

    Values that are missing, empty or zero are left out, and so is the whole section without any.
    """
    row = lambda name, value, there: F.when(there, F.concat(F.lit(f"| {name} | "), value.cast("string"), F.lit(" |")))
    text = lambda name, title: row(title, _given(calls, name), F.coalesce(_given(calls, name), F.lit("")) != "")
    number = lambda name, title, shown: row(title, shown(_given(calls, name, "double")), F.coalesce(_given(calls, name, "double"), F.lit(0.0)) != 0)
    rows = F.array_compact(F.array(
        number("duration_seconds", "Duration", human_duration), text("language", "Language"), text("backend", "Backend"), row("File Size", human_size(_given(calls, "size", "bigint")), _given(calls, "size", "bigint").isNotNull()), text("codec", "Codec"),
        number("sample_rate", "Sample Rate", lambda x: F.concat(x.cast("bigint").cast("string"), F.lit(" Hz"))), number("num_speakers", "Speakers", lambda x: x.cast("bigint")),
    ))
    head = F.lit("## Metadata\n\n| Property | Value |\n|----------|-------|\n")
    return calls.withColumn(out, F.when(F.size(rows) > 0, F.concat(head, F.array_join(rows, "\n"))).otherwise(F.lit("")))


NO_TRANSCRIPT = "*No transcript available.*"


def transcript_body(segments: DataFrame, doubtful: float = 0.4) -> DataFrame:
    """(call_id, body): a section with a heading and time whenever another speaker talks, then the texts; blank segments are skipped.

    Texts below the confidence ``doubtful`` are marked ``[?]``; those of no speaker have their time in front.
    """
    text = strip(F.coalesce("text", F.lit("")))
    speaker = F.nullif(F.col("speaker"), F.lit(""))
    before = F.last(speaker, ignorenulls=True).over(Window.partitionBy("call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    said = segments.filter(text != "").withColumn("_before", before)
    heading = F.when(speaker.isNotNull() & ~speaker.eqNullSafe(F.col("_before")), F.concat(F.lit("### "), speaker, F.when(F.col("start").isNotNull(), F.concat(F.lit(" — "), clock(F.col("start")))).otherwise(F.lit("")), F.lit("\n")))
    time = F.when(speaker.isNull() & F.col("start").isNotNull(), F.concat(F.lit("**["), clock(F.col("start")), F.lit("]** "))).otherwise(F.lit(""))
    mark = F.when(F.col("confidence") < doubtful, F.lit("[?] ")).otherwise(F.lit(""))
    lines = said.select("call_id", "pos", F.concat_ws("\n", heading, F.concat(time, mark, text, F.lit("\n"))).alias("line"))
    bodies = lines.groupBy("call_id").agg(F.array_join(ordered(F.col("line"), "pos"), "\n").alias("body"))
    every = segments.select("call_id").distinct().join(bodies, "call_id", "left")
    return every.select("call_id", F.concat_ws("\n\n", F.lit("## Transcript"), "body").alias("body")).withColumn("body", F.when(F.col("body") == "## Transcript", F.lit("## Transcript\n")).otherwise(F.col("body")))


def markdown(calls: DataFrame, segments: DataFrame, today: str | None = None) -> DataFrame:
    """(call_id, document): front matter, title, kind, metadata, summary, action items, decisions, questions, topics, speakers and transcript, with a blank line between.

    ``action_items`` may be texts or structs with text, assignee and deadline.
    """
    none = F.array().cast("array<string>")
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(items, "\n")))
    bullets = lambda name: F.transform(F.coalesce(_given(calls, name, "array<string>"), none), lambda x: F.concat(F.lit("- "), x))
    kind = calls.schema["action_items"].dataType.elementType
    fields = kind.fieldNames() if hasattr(kind, "fieldNames") else []
    part = lambda x, name: F.coalesce(x[name], F.lit("")) if name in fields else F.lit("")
    after = lambda value, left, right="": F.when(value != "", F.concat(F.lit(left), value, F.lit(right))).otherwise(F.lit(""))
    item = lambda x: F.concat(F.lit("- [ ] "), part(x, "text"), after(part(x, "assignee"), " — "), after(part(x, "deadline"), " (by ", ")")) if fields else F.concat(F.lit("- [ ] "), x)
    resolved = _given(calls, "speakers_resolved", "array<struct<display_name:string,speaker_cluster_id:string>>")
    shown = F.filter(F.transform(resolved, lambda s: F.coalesce(F.nullif(s["display_name"], F.lit("")), s["speaker_cluster_id"], F.lit(""))), lambda n: n != "")
    links = F.transform(shown, lambda n: F.concat(F.lit("[["), n, F.lit("]]")))
    full = metadata_table(front_matter(calls, today=today)).join(transcript_body(segments), "call_id", "left")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Transcript: "), F.col("stem")))
    text = lambda name: F.nullif(F.col(name), F.lit(""))
    return full.select(
        "call_id",
        F.concat_ws(
            "\n\n", "front_matter", F.concat(F.lit("# "), title), F.concat(F.lit("**Type:** "), text("classification")), text("metadata_table"), F.concat(F.lit("## Summary\n\n"), text("summary")), listed("Action Items", F.transform("action_items", item)),
            listed("Key Decisions", bullets("key_decisions")), listed("Questions Raised", bullets("questions_raised")), F.when(F.size("topics") > 0, F.concat(F.lit("**Topics:** "), F.array_join("topics", ", "))), F.when(F.size(links) > 0, F.concat(F.lit("**Speakers:** "), F.array_join(links, ", "))),
            F.coalesce("body", F.lit(NO_TRANSCRIPT)),
        ).alias("document"),
    )


def rttm_lines(turns: DataFrame) -> DataFrame:
    """(call_id, pos, line): turns in the space-separated speaker format."""
    number = lambda x: F.format_string("%.3f", x)
    return turns.select("call_id", "pos", F.concat_ws(" ", F.lit("SPEAKER"), F.col("call_id").cast("string"), F.lit("1"), number(F.col("start")), number(F.col("end") - F.col("start")), F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>")).alias("line"))


def subtitles(segments: DataFrame, kind: str = "srt") -> DataFrame:
    """(call_id, document): segments as numbered subtitles (``srt``), or as ``vtt``, ``tsv`` or ``txt``."""
    sep = "," if kind == "srt" else "."

    def stamp(x: Column) -> Column:
        ms = F.floor(x * 1000 + 0.5).cast("bigint")
        part = lambda v, n: padded(F.floor(v).cast("bigint"), n)
        return F.concat(part(ms / 3_600_000, 2), F.lit(":"), part(ms / 60_000 % 60, 2), F.lit(":"), part(ms / 1000 % 60, 2), F.lit(sep), part(ms % 1000, 3))

    text = strip(F.coalesce("text", F.lit("")))
    times = F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")))
    if kind == "srt":
        line = F.concat_ws("\n", (F.col("pos") + 1).cast("string"), times, text, F.lit(""))
    elif kind == "vtt":
        line = F.concat_ws("\n", times, text, F.lit(""))
    elif kind == "tsv":
        line = F.concat_ws("\t", F.floor(F.col("start") * 1000 + 0.5).cast("string"), F.floor(F.col("end") * 1000 + 0.5).cast("string"), F.replace(text, F.lit("\t"), F.lit(" ")))
    else:
        line = text
    body = F.array_join(ordered(line, "pos"), "\n")
    head = {"vtt": "WEBVTT\n\n", "tsv": "start\tend\ttext\n"}.get(kind, "")
    return segments.groupBy("call_id").agg(F.concat(F.lit(head), body).alias("document"))
