"""Names of all queries of the controls engine and their SQL."""

from __future__ import annotations

import payguard.sources.views  # noqa: F401
from payguard.operators import confidence, duplicates, fieldscores, grounding, lifecycle, matching, posting, quarantine, screening, snapshots, vendors  # noqa: F401
from payguard.plans.catalog import JOBS, query, text
from payguard.sources import documents, stores
from payguard.streaming import streams

QUERIES: dict = {name: query(name) for name in JOBS} | documents.QUERIES | stores.QUERIES | quarantine.QUERIES | duplicates.QUERIES | streams.QUERIES
ORACLE_SQL: dict[str, str] = {name: text(name, 1) for name in JOBS} | documents.oracle_sql() | stores.oracle_sql() | quarantine.oracle_sql() | streams.ORACLE_SQL
