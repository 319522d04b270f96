"""Measure earlier calls and feed the result back into the next scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import outcomes
from ..session import cut_lineage


def measure(calls: DataFrame, numbered_bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, scorecard, calibration profile).

    The outcomes feed two aggregates, so their lineage is cut once in the shared
    folder instead of being computed twice.
    """
    done = cut_lineage(outcomes.forward_outcomes(calls, numbered_bars))
    return done, outcomes.scorecard(done), outcomes.calibration_profile(done)


def calibrated(predictions: DataFrame, profile: DataFrame) -> DataFrame:
    return outcomes.apply_calibration(predictions, profile)
