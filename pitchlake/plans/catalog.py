"""Queries of the tracking operators and their SQL, by name."""

from __future__ import annotations

from . import q_matches, q_metrics, q_review, q_sql, q_tracking
from .base import Query


def queries() -> dict[str, Query]:
    return q_metrics.QUERIES | q_tracking.QUERIES | q_review.QUERIES | q_matches.QUERIES


def oracle_sql() -> dict[str, str]:
    return q_metrics.ORACLES | q_tracking.ORACLES | q_review.ORACLES | q_sql.ORACLES | q_matches.ORACLES
