"""The registered queries of the reference's operators, and their DuckDB SQL."""

from __future__ import annotations

from memspark.queries import evidence, further, graphs, plans, records, retrieval, scalars, streams, work

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _area in (scalars, retrieval, graphs, records, plans, evidence, work, further, streams):
    QUERIES |= _area.QUERIES
    ORACLE_SQL |= _area.ORACLE_SQL
