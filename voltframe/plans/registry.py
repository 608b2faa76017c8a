"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from voltframe.plans import files, networks, relations, series  # noqa: F401  (they register their queries)
from voltframe.plans.base import ORACLE, QUERIES  # noqa: F401
