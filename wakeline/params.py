"""Thresholds of the analysis, as keyword parameters with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RouteParams:
    # Fixed values the results depend on.
    min_latitude: float = -90.0
    max_latitude: float = 90.0
    min_longitude: float = -180.0
    max_longitude: float = 180.0
    km_per_deg_lat: float = 111.0
    km_per_deg_lon: float = 85.0
    max_jump_km: float = 100.0
    min_total_km: float = 0.0
    top_n: int = 10
    realistic_km: float = 1000.0
    hours: float = 24.0
    # These two change no result: the most of one vessel's history that meets in one task, and
    # whether copies of one report are counted in a shuffle of their own before reports are paired.
    stretch_seconds: int = 3_600
    count_copies_first: bool = False
    sample_fraction: float = 0.1
    sample_seed: int = 42


DEFAULTS = RouteParams()
