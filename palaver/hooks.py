"""Call sites of models. A hook is a function over pandas batches; the library brings none that needs a network or weights.

A factory runs once in each Python worker, so a model is loaded once however many batches it sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Backend = Callable[[pd.DataFrame], pd.DataFrame]
_BACKENDS: dict[str, tuple[Callable[[], Backend], str]] = {}
_LOADED: dict[str, Backend] = {}

#: Output of each kind of hook.
TRANSCRIPTION = "call_id string, pos int, start double, end double, text string, avg_logprob double"
DIARIZATION = "call_id string, pos int, start double, end double, speaker string"
EMBEDDING = "call_id string, local_label string, embedding array<double>"
SPEECH = "call_id string, start double, end double"
LANGUAGE = "call_id string, language string, probability double"
ANALYSIS = "call_id string, chunk_id int, response string, input_tokens bigint, output_tokens bigint"


def register(name: str, factory: Callable[[], Backend], schema: str) -> None:
    """Make a backend known under a name, with the schema of what it returns."""
    _BACKENDS[name] = (factory, schema)


def backends() -> list[str]:
    return sorted(_BACKENDS)


def run(rows: DataFrame, name: str, errors: bool = False) -> DataFrame:
    """The backend's output over the rows, batch by batch. With ``errors`` a batch that fails gives a row with the message instead of failing the job."""
    if name not in _BACKENDS:
        raise KeyError(f"no backend {name}; known: {', '.join(backends())}")
    factory, schema = _BACKENDS[name]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED[name] = factory()
        backend = _LOADED[name]
        for batch in batches:
            if not errors:
                yield backend(batch)
                continue
            try:
                yield backend(batch).assign(error=None, error_type=None)
            except Exception as e:  # the caller asked for errors as rows
                yield pd.DataFrame({"call_id": batch["call_id"], "error": str(e), "error_type": type(e).__name__})

    return rows.mapInPandas(call if not errors else _filled(call, schema), f"{schema}, error string, error_type string" if errors else schema)


def _filled(call, schema: str):
    names = [part.split()[0] for part in schema.split(", ")]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in call(batches):
            full = out.reindex(columns=[*names, "error", "error_type"]).astype(object)
            yield full.where(full.notna(), None)

    return fill
