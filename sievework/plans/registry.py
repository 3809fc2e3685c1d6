"""Registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from sievework.plans import audit, corpus, packages

QUERIES: dict = audit.QUERIES | corpus.QUERIES | packages.QUERIES
ORACLE: dict[str, str] = audit.ORACLE | corpus.ORACLE | packages.ORACLE
