"""Ordering of the enumerated values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailwarden.schemas import EVENT_TYPES, RISK_LEVELS


def _ordinal(value: Column, domain: tuple[str, ...]) -> Column:
    levels = F.array(*[F.lit(v) for v in domain])
    return F.when(value.isin(*domain), F.array_position(levels, value) - 1).cast("int")


def risk_rank(level: Column) -> Column:
    """0..3 by severity, -1 for an unrated (null) level."""
    return F.coalesce(_ordinal(level, RISK_LEVELS), F.lit(-1))


def risk_ordinal(level: Column) -> Column:
    """0..3 by severity, null for null."""
    return _ordinal(level, RISK_LEVELS)


def type_ordinal(event_type: Column) -> Column:
    return _ordinal(event_type, EVENT_TYPES)
