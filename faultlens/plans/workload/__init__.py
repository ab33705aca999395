"""Queries over the driver's tables."""

from faultlens.plans.workload import (  # noqa: F401
    file_queries,
    library_queries,
    nested_queries,
    relational_queries,
    source_queries,
    stat_queries,
    store_queries,
)
from faultlens.plans.workload.registry import ORACLE, QUERIES  # noqa: F401
