"""Named queries over the test tables, each with a DuckDB oracle where SQL can express it."""

from calibra.plans import (  # noqa: F401  (importing registers the queries)
    comparison,
    evaluation,
    monitoring,
    preparation,
    quality,
    registry_queries,
    streams,
    training,
)
from calibra.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
