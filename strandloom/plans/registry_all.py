"""Importing this module registers every query."""

from . import catalog as _catalog, engine, evaluate, placement, registry, sequence, slots  # noqa: F401

QUERIES = registry.QUERIES
