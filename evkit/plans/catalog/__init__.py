"""Registered queries: every operator on the test tables."""

from evkit.plans.catalog import (  # noqa: F401
    associations,
    joins,
    models,
    profiles,
    rows,
    streams,
    tallies,
    values,
)
from evkit.plans.catalog.registry import REGISTRY, Query, Tables, runner

__all__ = ["REGISTRY", "Query", "Tables", "runner"]
