"""The library's own queries, each with SQL where SQL states it."""

from . import joins_checks, records, rollups_ranks, rules, selections, storage, texts, waves  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
