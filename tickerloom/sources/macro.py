"""Macro readings: latest observation per series and the wide snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd

SERIES = (
    "treasury_10y",
    "treasury_2y",
    "treasury_5y",
    "treasury_30y",
    "yield_curve_10y_2y",
    "fed_funds",
    "unemployment",
    "cpi",
    "vix",
    "wti_oil",
    "dollar_index",
    "treasury_avg_interest_rate",
)


def reading(value: Column) -> Column:
    """Numeric value of a reading, NULL for "." and other non-numbers."""
    return value.try_cast("double")


def latest_observation(observations: DataFrame, look: int = 5) -> DataFrame:
    """Newest of the last `look` readings per source and series that has a value."""
    w = Window.partitionBy("source", "series").orderBy(F.desc("date"))
    recent = observations.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= look)
    known = recent.withColumn("value", reading(F.col("value"))).where(F.col("value").isNotNull())
    return known.groupBy("source", "series").agg(
        F.max_by("value", "date").alias("value"), F.max("date").alias("date")
    )


def snapshot(latest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One wide row (per `by`): official readings if there are any, else keyless ones.

    The 10y-5y curve is derived on the keyless side, where no official curve exists.
    """
    by = by or []
    official = F.col("source") == "official"
    values = [
        F.max(F.when(official & (F.col("series") == s), F.col("value"))).alias(f"_o_{s}") for s in SERIES
    ] + [F.max(F.when(~official & (F.col("series") == s), F.col("value"))).alias(f"_k_{s}") for s in SERIES]
    wide = latest.groupBy(*by).agg(F.max(official.cast("int")).alias("_official"), *values)
    chosen = [
        F.when(F.col("_official") == 1, F.col(f"_o_{s}")).otherwise(F.col(f"_k_{s}")).alias(s) for s in SERIES
    ]
    curve = F.when(F.col("_official") == 0, rnd(F.col("_k_treasury_10y") - F.col("_k_treasury_5y"), 3))
    source = F.when(F.col("_official") == 1, "official").otherwise("keyless")
    return wide.select(*by, source.alias("macro_source"), *chosen, curve.alias("yield_curve_10y_5y"))


def merged(observations: DataFrame) -> DataFrame:
    """One wide row per date with every series that was read on it."""
    known = observations.withColumn("value", reading(F.col("value")))
    wide = known.groupBy("date").pivot("series", list(SERIES)).agg(F.max("value"))
    return wide.withColumn("yield_curve_10y_5y", rnd(F.col("treasury_10y") - F.col("treasury_5y"), 3))
