"""The steps in their order, which is part of the meaning.

Clean, then sample if at all, then pair, then drop jumps, then sum. All results are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wakeline.operators.aggregate import moved
from wakeline.operators.report import top
from wakeline.operators.trajectory import coord_deltas, edge_distance, stretch_summary, vessel_summary, with_previous
from wakeline.params import DEFAULTS, RouteParams


def steps(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Cleaned reports with the previous position of their vessel."""
    return with_previous(positions, params)


def edges(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Every step with its length, jumps included."""
    return edge_distance(coord_deltas(steps(positions, params)), params)


def summary(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """One row per vessel for a whole run; persist it to take several results from it."""
    return vessel_summary(stretch_summary(positions, params), params)


def totals(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Kilometres and kept steps of every vessel that moved."""
    return moved(summary(positions, params), params)


def top_routes(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """The longest routes."""
    return top(totals(positions, params), params)
