"""Fit component weights from a walk-forward replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import replay
from ..sources import config


def fitted_profiles(spark: SparkSession, numbered_bars: DataFrame, benchmark: DataFrame, path: str | None = None) -> DataFrame:
    """Fitted weights of all profiles; written as JSON rows when a path is given."""
    own = config.profile_weights(spark)
    prior = config.resolve_weights(own.select("profile"), config.default_weights(spark), own)
    fitted = replay.tune(numbered_bars, benchmark, prior)
    if path:
        replay.write_fitted(fitted, path)
    return fitted
