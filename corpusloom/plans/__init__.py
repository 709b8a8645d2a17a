"""Named queries over the tables, grouped by family."""

from __future__ import annotations

from collections.abc import Iterator

from .registry import Registry


def registries() -> Iterator[Registry]:
    from . import graph_queries, incremental_queries, ingest_queries, memory_queries, module_queries, search_queries, upkeep_queries

    yield incremental_queries.incremental
    yield search_queries.search
    yield graph_queries.graph
    yield memory_queries.memory
    yield ingest_queries.ingest
    yield module_queries.module
    yield upkeep_queries.upkeep
