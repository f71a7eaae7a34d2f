"""Registered queries over the driver's tables, with equivalent SQL."""

from . import extensions, flows, names, stores  # noqa: F401  they register their queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
