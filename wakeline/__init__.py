"""Travelled distances of moving objects from their position reports, on Spark."""

from wakeline.params import RouteParams

__all__ = ["RouteParams"]
