"""Queries over the driver tables, with their SQL twins."""

from telluria.checks import base, ingest, learned, rows, series, stats, streams

QUERIES, SQL = base.QUERIES, base.SQL

__all__ = ["QUERIES", "SQL", "ingest", "learned", "rows", "series", "stats", "streams"]
