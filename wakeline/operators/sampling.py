"""Row samples, taken after cleaning and before reports are paired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.columns import hash_below
from wakeline.params import DEFAULTS


def bernoulli(
    positions: DataFrame, fraction: float = DEFAULTS.sample_fraction, seed: int = DEFAULTS.sample_seed
) -> DataFrame:
    """Each row with the same chance. The rows drawn depend on the partitioning."""
    return positions.sample(fraction=fraction, seed=seed)


def by_hash(positions: DataFrame, fraction: float = DEFAULTS.sample_fraction, key: str | None = None) -> DataFrame:
    """The rows whose hashed key is small: the same ones every time.

    The key is ``event_id`` if the reports have one, else all their columns; a null is a key
    like any other, so its rows are drawn together or not at all.
    """
    if key is None:
        key = "event_id" if "event_id" in positions.columns else None
    columns = [key] if key else positions.columns
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("null")) for name in columns]
    return positions.where(hash_below(F.concat_ws("|", *parts), fraction))
