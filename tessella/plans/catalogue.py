"""Imports every query family so that the registry is complete."""

from tessella.plans import (
    alerts,
    checks,
    cleaning,
    feature,
    models,
    panels,
    ratio,
    resolution,
    streaming,
    timeseries,
)
from tessella.plans.base import ORACLES, QUERIES

FAMILIES = (
    panels,
    cleaning,
    resolution,
    timeseries,
    ratio,
    feature,
    alerts,
    checks,
    models,
    streaming,
)

__all__ = ["FAMILIES", "ORACLES", "QUERIES"]
