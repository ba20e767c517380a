"""Every operator as a query over the given tables, with the SQL that states the same result."""

from . import events, models, pages, tables
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "events", "models", "pages", "tables"]
