"""Every registered query, grouped by domain."""

from __future__ import annotations

from .base import Query


def _catalogues():
    from . import chains, feeds, flows, market, measure, records, run_logs, runs, scoring, timeseries

    return [m.CATALOGUE for m in (timeseries, market, feeds, scoring, chains, measure, records, run_logs, flows, runs)]


def all_queries() -> dict[str, Query]:
    return {name: q for c in _catalogues() for name, q in c.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for c in _catalogues() for name, sql in c.oracles.items()}
