"""All registered queries of the panel engine with their DuckDB equivalents."""

from __future__ import annotations

from . import detail_queries, factor_queries, panel_queries, portfolio_queries, research_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (factor_queries, panel_queries, research_queries, portfolio_queries, detail_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
