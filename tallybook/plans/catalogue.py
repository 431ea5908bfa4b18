"""All named queries of the library; importing the modules registers them."""

from __future__ import annotations

from . import q_functions, q_games, q_league, q_merge, q_more, q_rankings, q_reconcile, q_tournaments  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "g19_rating_breakdown"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
