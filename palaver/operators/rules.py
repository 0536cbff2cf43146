"""Ordered rules as CASE expressions: errors, exit codes, paths, tiers, presets and field projection."""

from __future__ import annotations

import builtins
import json
import re
import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Exception types and message parts, tested in this order (permanent messages before transient ones).
PERMANENT_TYPES = ["FileNotFoundError", "ValueError", "TypeError", "PermissionError", "ImportError", "ModuleNotFoundError", "AttributeError", "KeyError"]
TRANSIENT_TYPES = ["TimeoutError", "ConnectionError", "BrokenPipeError", "MemoryError"]
PERMANENT_PARTS = ["not found", "invalid", "unsupported", "codec", "format", "permission denied", "no such file", "corrupt", "malformed", "too short", "empty file"]
TRANSIENT_PARTS = ["cuda", "out of memory", "oom", "timeout", "connection", "busy", "resource", "temporary", "unavailable", "retry", "disk full", "no space"]
AUTH_PARTS = ["token", "auth", "huggingface", "credentials"]
#: Exit codes.
OK, TRANSCRIPTION_ERROR, AUTH_ERROR, VALIDATION_ERROR, INTERNAL_ERROR = range(5)


def with_subtypes(names: list[str]) -> list[str]:
    """The named exception types and all known types below them, as Python's own hierarchy has it."""
    known = vars(builtins) | {c.__name__: c for c in (json.JSONDecodeError, subprocess.TimeoutExpired, subprocess.CalledProcessError)}
    kinds = {n: c for n, c in known.items() if isinstance(c, type) and issubclass(c, BaseException)}
    return sorted(n for n, c in kinds.items() if issubclass(c, tuple(kinds[x] for x in names)))


def contains_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def error_category(kind: Column, message: Column) -> Column:
    """``permanent`` or ``transient``; what no rule knows is transient."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(kind.isin(with_subtypes(PERMANENT_TYPES)), "permanent").when(kind.isin(with_subtypes(TRANSIENT_TYPES)), "transient").when(contains_any(text, PERMANENT_PARTS), "permanent").otherwise("transient")
    )


def should_retry(category: Column, strategy: Column, attempt: Column, most: Column) -> Column:
    return F.when(attempt >= most, False).when(strategy == "never", False).when(strategy == "always", True).otherwise(category == "transient")


def exit_code(kind: Column, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(contains_any(text, AUTH_PARTS), AUTH_ERROR)
        .when(kind.isin(with_subtypes(["ValueError", "FileNotFoundError", "TypeError"])), VALIDATION_ERROR)
        .when(kind.isin(with_subtypes(["RuntimeError", "OSError"])), TRANSCRIPTION_ERROR)
        .otherwise(INTERNAL_ERROR)
    )


def backoff_seconds(attempt: Column, most: float = 10.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def safe_path(path: Column, absolute: bool = False) -> Column:
    """Not blank, no control characters but tab and line breaks, and no ``..`` part; relative unless ``absolute``."""
    ok = F.rlike(path, F.lit(r"\S")) & ~F.rlike(path, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")) & ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))
    return ok if absolute else ok & ~F.startswith(path, F.lit("/"))


def safe_output_dir(path: Column) -> Column:
    """A safe path without wildcards."""
    return safe_path(path) & ~F.rlike(path, F.lit(r"[*?\[]"))


def windows_path(path: Column) -> Column:
    return F.rlike(path, F.lit(r"^[A-Za-z]:[\\/]"))


def translate_path(path: Column) -> Column:
    r"""``C:\x`` as ``/mnt/c/x``; other paths as they are."""
    rest = F.replace(F.substr(path, F.lit(4)), F.lit("\\"), F.lit("/"))
    return F.when(windows_path(path), F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), F.lit("/"), rest)).otherwise(path)


def recommended_tier(device: Column, gpu_mb: Column) -> Column:
    """Quality tier for a machine: by the memory of a CUDA device; ``mps`` is balanced, all else fast."""
    cuda = F.when(gpu_mb >= 8000, "high_quality").when(gpu_mb >= 4000, "balanced").otherwise("fast")
    return F.when(device == "cuda", cuda).when(device == "mps", "balanced").otherwise("fast")


def merged_settings(*sources: dict) -> dict:
    """Settings from weakest to strongest source; a value that is None overrides nothing."""
    out: dict = {}
    for source in sources:
        out |= {k: v for k, v in source.items() if v is not None}
    return out


def _tree(fields: list[str]) -> dict:
    tree: dict = {}
    for field in fields:
        at = tree
        for part in field.split("."):
            at = at.setdefault(part, {})
    return tree


def _pick(value: Column, kind: T.DataType, tree: dict) -> Column | None:
    if not tree:
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _pick(x, kind.elementType, tree)) if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else None
    if not isinstance(kind, T.StructType):
        return None
    parts = [(name, _pick(value[name], kind[name].dataType, sub)) for name, sub in tree.items() if name in kind.names]
    kept = [c.alias(n) for n, c in parts if c is not None]
    return F.struct(*kept) if kept else None


def project_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Columns and nested fields by dotted path, through structs and arrays of structs.

    A column whose own name holds the dots comes before a nested field; paths that lead nowhere are left out. The scan reads the named parts only.
    """
    plain = [f for f in fields if f in df.columns]
    nested = _tree([f for f in fields if f not in plain])
    columns = [F.col(f"`{f}`") for f in plain]
    for name, sub in nested.items():
        if name in df.columns and name not in plain:
            picked = _pick(F.col(f"`{name}`"), df.schema[name].dataType, sub)
            if picked is not None:
                columns.append(picked.alias(name))
    return df.select(*columns)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole name."""
    out = ""
    for c in pattern:
        out += {"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c))
    return f"^{out}$"


def top_languages(probabilities: Column, most: int = 10) -> Column:
    """The likeliest languages of a map as an array of (language, probability), likeliest first, ties by name."""
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("language"))))
    return F.transform(F.slice(ranked, 1, most), lambda e: F.struct(e["language"].alias("language"), (-e["p"]).alias("probability")))


#: Settings of each preset; those given explicitly win.
PRESETS = {
    "+subtitle": {"word_timestamps": True, "output_format": "srt"},
    "+meeting": {"diarize": True, "summarize": True, "word_timestamps": True},
    "+draft": {"tier": "draft"},
    "+hq": {"tier": "high_quality", "beam_size": 5},
}


def expand_preset(name: str | None, explicit: dict) -> dict:
    return merged_settings(PRESETS[name] if name else {}, explicit)


def job_settings(preset: Column, explicit: Column) -> Column:
    """Settings of a job as a map of text: those of its preset (none for a null or unknown one), with explicit ones that are not null on top."""
    presets = F.create_map(*[F.lit(x) if isinstance(x, str) else F.create_map(*[F.lit(str(y)) for kv in x.items() for y in kv]) for pair in PRESETS.items() for x in pair])
    none = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(F.try_element_at(presets, preset), none), F.coalesce(explicit, none), lambda _, own, given: F.coalesce(given, own))
    return F.map_filter(both, lambda _, v: v.isNotNull())
