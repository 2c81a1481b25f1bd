"""Registered queries over the given tables."""

from gaugework.queries.registry import ORACLE, QUERIES


def _load() -> None:
    from gaugework.queries import (  # noqa: F401
        composite, discovery, extraction, records, retrieval, stores, text, vectors,
    )


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
