"""Every registered query and its SQL, by name."""

from __future__ import annotations

from .plans import agreement, building, calibration, config, crowd, curves, evaluation, ground, lifecycle, messages, recordings, results, spatial, store, streams

PLANS = (agreement, calibration, config, crowd, evaluation, building, curves, ground, lifecycle, messages, recordings, results, spatial, store, streams)


def queries() -> dict:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for plan in PLANS for name, text in plan.ORACLE.items()}
