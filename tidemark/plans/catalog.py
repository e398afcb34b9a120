"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from tidemark.plans import documents, live, market, models, quality, trading
from tidemark.plans.base import ORACLES, QUERIES

flagship = market.flagship

__all__ = ["ORACLES", "QUERIES", "documents", "flagship", "live", "market", "models", "quality", "trading"]
