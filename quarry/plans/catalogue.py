"""All queries of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from . import q_events, q_query, q_tables, q_text  # noqa: F401  registers
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "agg_grouped"
