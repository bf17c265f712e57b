"""Every registered query with its check SQL."""

from reelshelf.queries import catalogue, ingest, jobs, visits  # noqa: F401
from reelshelf.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
