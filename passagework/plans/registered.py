"""All registered queries and their SQL."""

from __future__ import annotations

from passagework.plans import index_queries, log_queries, outline_queries, page_queries, question_queries, text_queries  # noqa: F401  (registers)
from passagework.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
