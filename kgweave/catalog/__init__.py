"""Registered queries: each a function of (spark, data folder), most with an equivalent SQL text."""
from .base import ORACLES, QUERIES
from . import evaluation, events, graphs, retrieval, text  # noqa: F401 - importing registers the queries

__all__ = ["QUERIES", "ORACLES"]
