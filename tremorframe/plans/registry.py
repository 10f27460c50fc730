"""All queries of the library, by name, and their SQL."""

from . import more_queries  # noqa: F401  registers its queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
