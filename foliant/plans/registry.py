"""Queries over the driver's tables, one per operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under a name, with SQL for the same rows."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import q_arrangement, q_boxes, q_content, q_documents, q_flow, q_kernels, q_pages, q_text, q_windows  # noqa: F401


load()
