"""User-extensible metric, aggregation and filter registries: names bound to Column builders."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

METRICS: dict[str, Callable[..., Column]] = {}
AGGREGATIONS: dict[str, Callable[..., Column]] = {}
FILTERS: dict[str, Callable[..., Column]] = {}


def _register(table: dict, name: str):
    def bind(fn):
        if name in table and table[name] is not fn:
            raise ValueError(f"{name!r} is already registered")
        table[name] = fn
        return fn
    return bind


def metric(name: str):
    return _register(METRICS, name)


def aggregation(name: str):
    return _register(AGGREGATIONS, name)


def response_filter(name: str):
    return _register(FILTERS, name)
