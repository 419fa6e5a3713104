"""Queries over the given tables, one module per domain."""

from marketlab.plans import chart, decision, documents, learning, price, records, research, streams, timejoins, trades  # noqa: F401
from marketlab.plans.registry import ORACLES, QUERIES, SURVEY_IDS

__all__ = ["ORACLES", "QUERIES", "SURVEY_IDS"]
