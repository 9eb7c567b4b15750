"""All registered queries."""

from . import encoders, learning, profiles, quality, roles, scores, tables_and_columns  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
