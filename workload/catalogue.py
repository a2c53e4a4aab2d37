"""All registered queries."""

from workload import (  # noqa: F401
    entity_queries,
    graph_queries,
    hit_queries,
    nested_queries,
    review_queries,
    rule_queries,
    source_queries,
    stats_queries,
    text_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
