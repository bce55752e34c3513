"""All registered queries of the engine and the SQL that each one must equal where SQL can say it."""

from __future__ import annotations

from . import q_analytics, q_ingest, q_search

QUERIES = q_search.QUERIES | q_ingest.QUERIES | q_analytics.QUERIES
ORACLES = q_search.ORACLES | q_ingest.ORACLES | q_analytics.ORACLES
