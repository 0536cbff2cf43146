"""Whole jobs out of the operators: enriching transcripts and analysing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.analysis import merge_analyses, merge_speakers
from palaver.operators.hints import name_hints, routed_hints
from palaver.operators.identity import aggregate_confidence, label_segments, name_stages, resolve_calls
from palaver.operators.intervals import majority_speaker, midpoint_speaker
from palaver.operators.quality import apply_filter, flag_segments
from palaver.operators.reports import speaking_time
from palaver.operators.sequence import chunks, consecutive_dedup


def enrich(segments: DataFrame, turns: DataFrame, embeddings: DataFrame | None = None, mode: str = "auto", threshold: float = 0.7, calls: DataFrame | None = None, attendees: DataFrame | None = None) -> DataFrame:
    """Segments deduplicated, flagged, filtered, attributed to local speakers and, with embeddings, to clusters over calls.

    With embeddings the turn at a segment's midpoint speaks; without, the speaker of the largest overlap. ``calls`` may give (call_id, call_order), ``attendees``
    (call_id, pos, name, score) the people of its calendar event; these and the names said in the transcript then weigh in the confidence.
    """
    clean = apply_filter(flag_segments(consecutive_dedup(segments)), mode)
    if embeddings is None:
        return majority_speaker(clean, turns)
    local = midpoint_speaker(clean, turns)
    time = speaking_time(turns).select("call_id", F.col("speaker").alias("local_label"), F.col("seconds").alias("speaking_seconds"))
    speakers = embeddings.join(time, ["call_id", "local_label"], "left").withColumn("speaking_seconds", F.coalesce("speaking_seconds", F.lit(0.0)))
    speakers = speakers.join(calls.select("call_id", "call_order"), "call_id") if calls is not None else speakers.withColumn("call_order", F.col("call_id"))
    resolved = resolve_calls(speakers, threshold).withColumn("display_name", F.lit(None).cast("string"))
    named = aggregate_confidence(name_stages(resolved, attendees, routed_hints(name_hints(local))))
    return label_segments(local, named)


def analyze(segments: DataFrame, model: Callable[[DataFrame], DataFrame], **limits) -> DataFrame:
    """Chunk each call, have the model analyse the chunks (call_id, chunk_id, text) and merge its answers (see ``merge_analyses``)."""
    parts = chunks(segments, **limits).select("call_id", "chunk_id", "text")
    answers = model(parts)
    merged = merge_analyses(answers)
    return merged.join(merge_speakers(answers), "call_id", "left") if "speakers" in answers.columns else merged
