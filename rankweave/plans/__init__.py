"""The registered queries, each beside the SQL that it is held against."""

from __future__ import annotations


def all_queries() -> dict:
    """name -> (query, SQL or None)."""
    from . import checks, grids, learned, lexical, logs, ranking, rerank, semantic

    return logs.QUERIES | ranking.QUERIES | lexical.QUERIES | semantic.QUERIES | checks.QUERIES | grids.QUERIES | rerank.QUERIES | learned.QUERIES
