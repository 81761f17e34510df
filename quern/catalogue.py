"""All queries of the core with their SQL twins."""

from __future__ import annotations

from quern.plans import dedup, evaluation, extras, ingest, lifecycle, notes, recall, redaction, relations, retrieval, sessions, star, streams, textual, trust  # noqa: F401
from quern.registry import QUERIES, TWINS


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
