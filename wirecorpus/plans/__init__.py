"""Registered queries, each next to its oracle SQL."""

from __future__ import annotations

from wirecorpus.plans import (
    corpus_queries, file_queries, metric_queries, packet_queries, routing_queries, stream_queries, token_queries,
)
from wirecorpus.plans.registry import Query

MODULES = [packet_queries, corpus_queries, token_queries, routing_queries, metric_queries, stream_queries, file_queries]


def all_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.R.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.R.oracles.items()}
