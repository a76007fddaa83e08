"""Registered queries over the given tables."""

from claimweave.plans import archive_queries, graph_queries, text_queries  # noqa: F401
from claimweave.plans.registry import ORACLES, QUERIES, bind

__all__ = ["ORACLES", "QUERIES", "bind"]
