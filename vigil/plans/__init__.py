"""Registered queries over the driver tables, each with a DuckDB oracle."""

from vigil.plans.registry import ORACLES, QUERIES  # noqa: F401
