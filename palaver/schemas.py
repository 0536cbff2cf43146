"""Canonical tables of the library as DDL; readers use these and never infer a schema."""

from __future__ import annotations

WORD = "struct<word:string,start:double,end:double,probability:double,speaker:string>"
SEGMENT_FIELDS = (
    f"id int, start double, end double, text string, words array<{WORD}>, confidence double, no_speech_prob double, temperature double, "
    "avg_logprob double, compression_ratio double, speaker string, speaker_cluster_id string, speaker_confidence double"
)
SEGMENT = f"call_id string, pos int, {SEGMENT_FIELDS}, speakers array<string>, is_overlap boolean"
TURN = "call_id string, pos int, start double, end double, speaker string"
IDENTITY = (
    "speaker_cluster_id string, canonical_name string, aliases array<string>, status string, embedding_centroid array<double>, sample_count bigint, "
    "first_seen string, last_seen string, total_calls bigint, total_speaking_seconds double, typical_co_speakers array<string>, created_from string, updated_at string"
)
OCCURRENCE = (
    "occurrence_id string, call_id string, speaker_cluster_id string, local_label string, display_name string, identity_status string, "
    "resolution_source string, resolution_confidence double, total_speaking_seconds double"
)
EVIDENCE = "evidence_id string, speaker_cluster_id string, call_id string, type string, score double, summary string, details map<string,string>, created_at string"
MANIFEST_FIELDS = (
    "status string, tier string, version string, last_updated double, checkpoint string, error string, error_category string, backend string, "
    "confidence double, hallucination_flags bigint, filename string, duration_seconds double, word_count bigint, language string"
)
MANIFEST = f"hash string, {MANIFEST_FIELDS}"
USAGE = "timestamp double, model string, call_id string, task string, input_tokens bigint, output_tokens bigint, cost_usd double, duration_seconds double"
ACTION = "struct<text:string,action:string,assignee:string,owner:string,deadline:string>"
ANALYSIS_FIELDS = (
    "title string, summary string, classification string, speakers array<struct<label:string,id:string,likely_name:string,name:string,evidence:string,role:string>>, "
    f"action_items array<{ACTION}>, topics array<string>, key_decisions array<string>, questions_raised array<string>"
)
ANALYSIS = f"call_id string, {ANALYSIS_FIELDS}"


def struct(fields: str) -> str:
    """``a int, b string`` as a struct type; commas inside brackets stay."""
    out, depth, item = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = item.strip().partition(" ")
            out.append(f"{name}:{kind.strip()}")
            item = ""
        else:
            item += c
    return f"struct<{','.join(out)}>"


TRANSCRIPT = (
    f"text string, language string, backend string, segments array<{struct(SEGMENT_FIELDS)}>, title string, summary string, classification string, "
    f"topics array<string>, action_items array<{ACTION}>, llm_analysis {struct(ANALYSIS_FIELDS)}, "
    "metadata struct<file:struct<name:string,path:string,created:string,modified:string,created_time:string,modified_time:string>,"
    "audio:struct<duration_seconds:double,creation_time:string>,tags:map<string,string>>, duration_seconds double"
)
TABLES = {"segment": SEGMENT, "turn": TURN, "identity": IDENTITY, "occurrence": OCCURRENCE, "evidence": EVIDENCE, "manifest": MANIFEST, "llm_usage": USAGE, "analysis": ANALYSIS, "transcript": TRANSCRIPT}
