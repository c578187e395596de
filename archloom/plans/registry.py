"""Queries of the web-archive operators and their SQL, by name."""

from __future__ import annotations

from . import crawls, extraction, relational, streams, urls  # noqa: F401  each registers its queries
from .kit import ORACLE_SQL, QUERIES  # noqa: F401
