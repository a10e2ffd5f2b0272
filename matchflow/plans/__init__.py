"""Registered queries: each operator bound to a driver table, with its DuckDB equivalent."""

from matchflow.plans import audit, layout, outline, pages, postings, runs, sources, telemetry, text  # noqa: F401
from matchflow.plans.registry import ORACLES, QUERIES  # noqa: F401
