"""Registered queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from .oracle import SQL
from .queries import QUERIES

__all__ = ["QUERIES", "SQL"]
