"""All registered queries of the transit operators, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from fleetspan.plans import base, catalogue, detector, findings, modelling, reports, routes, windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (base, detector, findings, reports, modelling, catalogue, routes, windows):
    QUERIES |= _part.BOOK.queries
    ORACLE_SQL |= _part.BOOK.oracles
