"""Query catalogue."""


def all_queries():
    """(queries, oracles) of the whole catalogue."""
    from . import queries, queries_bytes, queries_detect, queries_more, queries_records  # noqa: F401  these register
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
