"""All registered queries with their reference SQL."""

from __future__ import annotations

from palaver.plans import identity_queries, interval_queries, report_queries, stream_queries, text_queries  # noqa: F401
from palaver.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
