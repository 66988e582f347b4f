"""All queries of the engine and, where there is one, their SQL."""

from __future__ import annotations

from . import advisories, languages, manifests, matching, models, relational, retrieval  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
