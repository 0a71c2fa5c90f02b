"""All queries of the surveillance operators by name, with the SQL that says what each returns."""

from __future__ import annotations

from resistrum.plans import analysis, catalogue, interchange, scanning, screening  # noqa: F401  the others add their queries to those of analysis

QUERIES: dict = dict(analysis.QUERIES)
ORACLE_SQL: dict = dict(analysis.ORACLE_SQL)
