"""Queries over the driver's tables, and the requests of an index as methods."""

from . import api_queries, index_queries, queries  # noqa: F401  registers every query
