"""All registered queries."""

from __future__ import annotations

from . import q_browse, q_ingest, q_quality, q_scalars, q_signals, q_sources  # noqa: F401  (register their queries)
from .registry import QUERIES


def all_queries():
    return dict(QUERIES)
